"""Output paths and directories that don't collide and stay the same from run to run.

Names are given in turn: the first that asks takes ``x``, the next ``x_2``, ``x_3``. Where a suffixed name can't be
another's stem, the k-th new row takes the k-th free number, in groups of any size; where it can (directory keys such as
``a`` and ``a_2``), rows that can meet form a family, and each family is walked in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.functions import expr as x
from heronry.operators.places import free_numbers
from heronry.sources.tables import cut

OVERLAY_MODES = ("merged", "both", "originals")


def capture(df: DataFrame) -> DataFrame:
    """df with ``capture`` (local, offset, source): the entry's time if the pairing is exact, else the embedded time,
    else midnight of the file name's day.

    df: confidence, entry_moment, zone, embedded_local, embedded_offset, day.
    """
    entry = x.to_local(F.col("entry_moment"), F.col("zone"))
    midnight = F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))
    pick = lambda local, offset, source: F.struct(local.alias("local"), offset.cast("int").alias("offset"), F.lit(source).alias("source"))
    chain = F.coalesce(
        F.when((F.col("confidence") == "exact") & F.col("entry_moment").isNotNull(), pick(entry["local"], entry["offset"], "entry")),
        F.when(F.col("embedded_local").isNotNull(), pick(F.col("embedded_local"), F.coalesce("embedded_offset", F.lit(0)), "embedded")),
        F.when(midnight.isNotNull(), pick(midnight, F.lit(0), "filename")),
    )
    return df.withColumn("capture", chain)


def media_date(created: Column, epoch_ms: Column, embedded: Column, day: Column) -> Column:
    """A struct of moment and source: the message's time, its epoch, the embedded time, the file name's day."""
    tagged = lambda c, source: F.when(c.isNotNull(), F.struct(c.alias("moment"), F.lit(source).alias("source")))
    return F.coalesce(tagged(created, "created"), tagged(x.epoch_moment(epoch_ms), "epoch"), tagged(embedded, "embedded"), tagged(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "filename"))


def disposition(token: Column, leg: Column, moment: Column) -> Column:
    """excluded for thumbnails; deferred (unknown format, then no real date); planned otherwise."""
    what = F.when(token == "thumbnail", F.struct(F.lit("excluded").alias("disposition"), F.lit("thumbnail").alias("why")))
    what = what.when(leg.isNull(), F.struct(F.lit("deferred").alias("disposition"), F.lit("unknown_format").alias("why")))
    what = what.when(moment.isNull(), F.struct(F.lit("deferred").alias("disposition"), F.lit("no_date").alias("why")))
    return what.otherwise(F.struct(F.lit("planned").alias("disposition"), F.lit(None).cast("string").alias("why")))


def overlay_flags(mode: str, has_overlay: Column) -> tuple[Column, Column]:
    """Whether the overlay is merged into the output, and whether originals are kept beside it."""
    if mode not in OVERLAY_MODES:
        raise ValueError(f"mode must be one of {OVERLAY_MODES}")
    return has_overlay & F.lit(mode in ("merged", "both")), has_overlay & F.lit(mode in ("both", "originals"))


def select_conversations(timeline: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the selected (export_id, conversation)."""
    return timeline.join(selection.select("export_id", "conversation").distinct(), ["export_id", "conversation"], "left_semi")


def require_formats(formats: list[str]) -> None:
    if not formats:
        raise ValueError("no format is selected")


def allocate_paths(plan: DataFrame, recorded: DataFrame, order: list[str]) -> DataFrame:
    """plan with ordinal, output_path and adopted.

    plan: export_id, source_id, dir, stem, ext and the columns of order. recorded: export_id, source_id,
    output_path of earlier runs. An item keeps its recorded path if that lies in its directory; other recorded paths
    stay reserved, whoever they belong to. Of two items recorded on one path the lower source_id keeps it. The rest
    take the lowest free numbers of their stem, in order, without regard to ASCII case.
    """
    group = ["export_id", "g"]
    rows = plan.withColumn("g", x.fold(F.concat_ws("/", "dir", F.concat("stem", F.lit("."), "ext"))))
    rec = recorded.filter("output_path is not null").select("export_id", F.col("source_id").alias("r_source"), F.col("output_path").alias("r_path"), x.fold(F.col("output_path")).alias("folded"))
    owner = rec.groupBy("export_id", "folded").agg(F.min_by(F.struct("r_source", "r_path"), "r_source").alias("o"))
    keep = owner.select("export_id", F.col("o.r_source").alias("source_id"), F.col("o.r_path").alias("r_path"), "folded")
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    adopted = rows.join(keep, ["export_id", "source_id"], "left").withColumn("adopted", F.coalesce(x.fold(parent(F.col("r_path"))) == x.fold(F.col("dir")), F.lit(False)))
    new = adopted.filter("not adopted").drop("r_path", "folded")
    # numbers that recorded paths take from a stem
    name = r"^(.*/)?([^/]*?)(?:_([1-9][0-9]*))?\.([^./]*)$"
    number = F.regexp_extract("folded", name, 3)
    plain = F.struct(F.col("folded").alias("g"), F.lit(0).cast("long").alias("ordinal"))
    suffixed = F.struct(F.concat(F.regexp_extract("folded", name, 1), F.regexp_extract("folded", name, 2), F.lit("."), F.regexp_extract("folded", name, 4)).alias("g"), (number.try_cast("long") - 1).alias("ordinal"))
    taken = owner.select("export_id", F.explode(F.array(plain, F.when((number != "") & (number.try_cast("long") >= 2), suffixed))).alias("t")).filter("t is not null").select("export_id", "t.g", "t.ordinal").distinct()
    numbered = free_numbers(new, taken, group, [F.col(c) for c in order], "ordinal")
    named = numbered.withColumn("output_path", F.concat("dir", F.lit("/"), x.output_name(F.col("stem"), F.col("ext"), F.col("ordinal"))))
    columns = [*plan.columns, "ordinal", "output_path", "adopted"]
    kept = adopted.filter("adopted").withColumn("ordinal", F.lit(None).cast("long")).withColumn("output_path", F.col("r_path"))
    return named.select(*columns).unionByName(kept.select(*columns))


def _roots(keys: DataFrame, key: list[str], name: str) -> DataFrame:
    """Names with ``root``: the name left when suffixes ``_n`` are taken off one by one while the shorter name is asked for too. Names that stand for
    themselves are left out.

    keys: distinct rows of key and name. All shorter forms of a name are looked up at once, however many there are.
    """
    shape = r"(?s)^(.*?)((?:_[0-9]+)*)\z"
    base, tail = F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 2)
    parts = F.filter(F.split(tail, "_"), lambda p: p != "")
    shorter = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.concat("base", F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - k), lambda p: F.concat(F.lit("_"), p)), "")).alias("base")))
    suffixed = keys.filter(F.col(name).rlike(r"_[0-9]+\z")).select(*key, name, base.alias("base"), parts.alias("parts"))
    each = suffixed.select(*key, name, F.explode(shorter).alias("s")).select(*key, name, "s.k", F.col("s.base").alias("base")).filter("base <> ''")
    asked = keys.select(*key, F.col(name).alias("base"))
    there = each.join(asked, [*key, "base"]).groupBy(*key, name).agg(F.map_from_entries(F.collect_list(F.struct("k", "base"))).alias("there"))
    # the longest run of shorter names, from one suffix less on, that are all asked for
    run = F.aggregate(F.array_sort(F.map_keys("there")), F.lit(0), lambda acc, k: F.when(k == acc + 1, k).otherwise(acc))
    rooted = there.select(*key, name, F.try_element_at("there", run).alias("root"))
    return rooted.filter("root is not null")


def _number_of(name: Column, stem: Column) -> Column:
    """1 for the stem itself, n for ``stem_n``, else null."""
    rest = F.substring(name, F.length(stem) + 2, F.lit(1 << 30))
    suffixed = F.startswith(name, F.concat(stem, F.lit("_"))) & rest.rlike(r"^([2-9]|[1-9][0-9]{1,17})\z")
    return F.when(name == stem, F.lit(1).cast("long")).when(suffixed, rest.try_cast("long"))


def _claim_in_order(requests: DataFrame, reserved: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """requests (key, order, name) with ``claimed``: the name, or name_2 and so on, that nothing before holds.

    reserved: key, folded. Where a family's requests all ask for one name, the k-th takes the k-th free number, in
    groups of any size; families of several names, such as ``a`` and ``a_2``, are walked one by one.
    """
    rows = cut(requests.withColumn("folded", x.fold(F.col("name"))), "requests")
    taken = cut(reserved.select(*key, "folded").distinct(), "reserved")
    # few names have a root, so that requests don't move for it; null keys ask for nothing
    roots = cut(_roots(rows.select(*key, "folded").unionByName(taken).distinct(), key, "folded"), "families")
    related = lambda t: t.dropna(subset=[*key, "folded"]).join(roots, [*key, "folded"], "left").withColumn("family", F.coalesce("root", "folded")).drop("root")
    group = [*key, "family"]
    rows = related(rows)
    held = related(taken)
    kinds = rows.groupBy(*group).agg(F.min("folded").alias("low"), F.max("folded").alias("high"))
    mixed = cut(kinds.filter("low < high").select(*group), "mixed")
    numbers = None
    if not taken.isEmpty():
        one = kinds.filter("low = high").select(*group, F.col("low").alias("stem"))
        numbers = held.join(one, group).select(*group, _number_of(F.col("folded"), F.col("stem")).alias("__number"))
    asked = rows.join(mixed, group, "left_anti")
    # a request may bring columns called like ours
    alone = asked.select(*group, F.struct(*(c for c in requests.columns if c not in key)).alias("asked"))
    alone = free_numbers(alone, numbers, group, [F.col(f"asked.{c}") for c in order], "__number", 1).select(*key, "asked.*", "__number")
    suffix = F.when(F.col("__number") > 1, F.concat(F.lit("_"), F.col("__number").cast("string"))).otherwise("")
    alone = alone.select(*requests.columns, F.concat("name", suffix).alias("claimed"))

    columns = requests.columns

    def walk(asking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        used, out, tried = set(holding["folded"]), [], {}
        asking = asking.sort_values(order, kind="stable")
        for name, folded in zip(asking["name"], asking["folded"], strict=True):
            n, end = tried.get(folded, (1, ""))
            while folded + end in used:
                n += 1
                end = f"_{n}"
            tried[folded] = n, end
            used.add(folded + end)
            out.append(name + end)
        return asking[columns].assign(claimed=out)

    many = rows.join(mixed, group, "left_semi")
    schema = T.StructType([*requests.schema.fields, T.StructField("claimed", T.StringType())])
    # columns of its own, since both sides stem from the same names; names that nobody asks for stay out
    holding = held.join(mixed, group, "left_semi")
    holding = holding.toDF(*holding.columns)
    return alone.unionByName(many.groupBy(*group).cogroup(holding.groupBy(*group)).applyInPandas(walk, schema))


def allocate_dirs(keys: DataFrame, recorded: DataFrame | None = None, occupied: DataFrame | None = None) -> DataFrame:
    """export_id, conversation, dir and adopted for each conversation, keys in sorted order.

    recorded: export_id, conversation, dir of earlier runs; a conversation keeps the lowest of its own that no
    conversation before it took. occupied: export_id, dir of those that nobody may take. Directories that departed
    stay reserved, and so does the one for items without a conversation.
    """
    rows = keys.select("export_id", "conversation").distinct()
    none = F.lit(x.NO_CONVERSATION_DIR)
    spark = keys.sparkSession
    recorded = spark.createDataFrame([], "export_id string, conversation string, dir string") if recorded is None else recorded
    occupied = spark.createDataFrame([], "export_id string, dir string") if occupied is None else occupied
    wish = recorded.filter(x.fold(F.col("dir")) != none).select("export_id", "conversation", "dir", x.fold(F.col("dir")).alias("folded")).join(rows, ["export_id", "conversation"], "left_semi").distinct()
    rivals = wish.groupBy("export_id", "folded").agg(F.countDistinct("conversation").alias("rivals"))
    asked = wish.join(rivals, ["export_id", "folded"]).groupBy("export_id", "conversation").agg(F.max("rivals").alias("rivals"), F.min("dir").alias("dir"))
    calm = asked.filter("rivals = 1").select("export_id", "conversation", "dir")
    contested = wish.join(asked.filter("rivals > 1").select("export_id", "conversation"), ["export_id", "conversation"], "left_semi")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for conversation, mine in group.sort_values(["conversation", "dir"]).groupby("conversation", sort=True):
            for d, f in zip(mine["dir"], mine["folded"], strict=True):
                if f not in taken:
                    taken.add(f)
                    out.append((mine["export_id"].iloc[0], conversation, d))
                    break
        return pd.DataFrame(out, columns=["export_id", "conversation", "dir"])

    kept = calm.unionByName(contested.groupBy("export_id").applyInPandas(settle, "export_id string, conversation string, dir string"))
    kept = cut(kept, "kept-dirs")
    reserved = kept.select("export_id", x.fold(F.col("dir")).alias("folded")).unionByName(occupied.select("export_id", x.fold(F.col("dir")).alias("folded"))).unionByName(recorded.select("export_id", x.fold(F.col("dir")).alias("folded"))).unionByName(rows.select("export_id", none.alias("folded"))).distinct()
    new = rows.join(kept, ["export_id", "conversation"], "left_anti").withColumn("name", x.dir_name(F.col("conversation")))
    named = _claim_in_order(new, reserved, ["export_id"], ["conversation"])
    return kept.withColumn("adopted", F.lit(True)).unionByName(named.select("export_id", "conversation", F.col("claimed").alias("dir"), F.lit(False).alias("adopted")))


def allocate_copies(plan: DataFrame) -> DataFrame:
    """plan with ``copy``: names of kept originals, in plan order, main before overlay, ``stem_2.ext`` on a clash.

    plan: export_id, dir, seq, part (0 main, 1 overlay), stem, ext.
    """
    rows = plan.withColumn("name", F.col("stem")).withColumn("fext", x.fold(F.col("ext")))
    none = rows.select("export_id", "dir", "fext", F.lit("").alias("folded")).limit(0)
    out = _claim_in_order(rows, none, ["export_id", "dir", "fext"], ["seq", "part"])
    return out.withColumn("copy", F.concat("claimed", F.lit("."), "ext")).drop("claimed", "name", "fext")


def document_names(dirs: DataFrame, formats: dict[str, str]) -> DataFrame:
    """The reserved document name of each format in each conversation's directory."""
    names = F.explode(F.array(*(F.struct(F.lit(f).alias("format"), F.lit(f"history.{e}").alias("name")) for f, e in formats.items()))).alias("d")
    return dirs.select("*", names).select(*dirs.columns, "d.format", F.concat("dir", F.lit("/"), "d.name").alias("document_path"))


def recorded_dirs(items: DataFrame, attribution: DataFrame) -> DataFrame:
    """Directories of earlier runs for each conversation: from claims, and from where its finished media lie.

    attribution: export_id, token, conversation.
    """
    claimed = items.filter((F.col("status") == "claimed") & F.col("output_path").isNotNull()).select("export_id", F.col("source_id").alias("conversation"), x.base_name(F.col("output_path")).alias("dir"))
    placed = items.filter((F.col("kind") == "chat_media") & F.col("output_path").isNotNull()).select("export_id", F.col("source_id").alias("token"), F.element_at(F.split("output_path", "/"), -2).alias("dir"))
    return claimed.unionByName(placed.join(attribution, ["export_id", "token"]).select("export_id", "conversation", "dir")).distinct()


def status_overlay(plan: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """plan with the status of each row's item; pending if the table does not hold it."""
    now = items.filter(F.col("kind") == kind).select("export_id", "source_id", "status")
    return plan.join(now, ["export_id", "source_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
