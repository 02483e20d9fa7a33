"""Manifest entries, media files and message tokens brought together.

All tables carry export_id, which leads every key. Where files or entries are taken in turn, the k-th of one
side takes the k-th of the other, so that turn-taking becomes a join on row numbers within small buckets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators.zones import assign_zone as assign_zone
from heronry.sources.tables import cut

BUCKET = ("export_id", "day", "kind")
#: Chains of days of one export and kind that are walked in one call.
CHAINS = 64


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number and count of each row within its bucket."""
    bucket = Window.partitionBy(*BUCKET)
    return rows.withColumn("rn", F.row_number().over(bucket.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(bucket))


def _buckets(entries: DataFrame, media: DataFrame) -> DataFrame:
    """Entries and media of a bucket side by side, each in its turn, as structs; one is null where a side ran out."""
    e = _ranked(entries.filter(F.col("day").isNotNull()), ["entry_index"])
    m = _ranked(media, ["uuid"])
    m_side = m.select(*BUCKET, "rn", F.col("n").alias("m_n"), F.struct(*[c for c in media.columns if c not in BUCKET]).alias("media"))
    e_side = e.select(*BUCKET, "rn", F.col("n").alias("e_n"), F.struct(*[c for c in entries.columns if c not in BUCKET]).alias("entry"))
    return e_side.join(m_side, [*BUCKET, "rn"], "full")


def bucket_match(entries: DataFrame, media: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and media of one day and kind, in turn: entries by entry_index, media by uuid.

    Gives the pairs (confidence exact if the bucket holds one of each, else ambiguous), the entries left over,
    and the media left over. Entries without a day stay left over. written: write what the three have in common, for
    callers that need them all.
    """
    both = _buckets(entries, media)
    if written:
        both = cut(both, "buckets")
    confidence = F.when((F.col("e_n") == 1) & (F.col("m_n") == 1), "exact").otherwise("ambiguous")
    pairs = both.filter("entry is not null and media is not null").select(*BUCKET, "entry", "media", confidence.alias("confidence"))
    left = both.filter("entry is not null and media is null").select(*BUCKET, "entry.*").unionByName(entries.filter(F.col("day").isNull()))
    return pairs, left.select(*entries.columns), both.filter("media is not null and entry is null").select(*BUCKET, "media.*").select(*media.columns)


def islands(rows: DataFrame, day: str = "day") -> DataFrame:
    """rows with ``island``: days of one export and kind that follow each other without a gap share a number.

    Rows whose day no calendar has get null.
    """
    d = F.datediff(F.try_to_date(F.col(day), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    days = rows.select("export_id", "kind", d.alias("d")).filter("d is not null").distinct()
    by = Window.partitionBy("export_id", "kind").orderBy("d")
    new = F.coalesce((F.col("d") - F.lag("d").over(by) > 1).cast("int"), F.lit(0))
    marked = days.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    tagged = rows.withColumn("d", d).join(marked.drop("new"), ["export_id", "kind", "d"], "left")
    return tagged.drop("d")


def _linked_days(entries: DataFrame, media: DataFrame) -> DataFrame:
    """export_id, kind, d (a day number), n_media and chain: days that follow each other and hold opposite sides, so
    that an entry of one may take a medium of the other, share a chain; a chain holds both sides.

    entries and media: export_id, kind, d.
    """
    key = ["export_id", "kind", "d"]
    count = lambda side, n: side.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    days = count(entries, "n_entries").join(count(media, "n_media"), key, "full").fillna(0, ["n_entries", "n_media"])
    by = Window.partitionBy("export_id", "kind").orderBy("d")
    before = lambda c: F.lag(c).over(by)
    meets = ((F.col("n_entries") > 0) & (before("n_media") > 0)) | ((F.col("n_media") > 0) & (before("n_entries") > 0))
    tied = F.coalesce((before("d") == F.col("d") - 1) & meets, F.lit(False))
    chained = days.withColumn("new", (~tied).cast("int")).withColumn("chain", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    size = Window.partitionBy("export_id", "kind", "chain")
    return chained.withColumn("days", F.count(F.lit(1)).over(size)).filter("days > 1").select(*key, "n_media", "chain")


def adjacent_match(entries: DataFrame, media: DataFrame) -> DataFrame:
    """export_id, entry_index and uuid of entries that take media a day off, by the residues of bucket_match.

    Entries in order try the next day, then the day before, and take the first medium by uuid that is left. The
    order matters, so chains of days that can meet are walked, on entry numbers, day numbers and counts of media
    alone; the media that an entry takes come by a join on their ranks. After bucket_match a day holds one side only,
    so a chain ends wherever two days hold the same one.
    """
    number = F.datediff(F.try_to_date(F.col("day"), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    e = entries.select("export_id", "kind", number.alias("d"), "entry_index").filter("d is not null")
    m = media.select("export_id", "kind", number.alias("d"), "uuid").filter("d is not null")
    days = cut(_linked_days(e, m), "linked-days")
    key = ["export_id", "kind", "d"]
    # a call to pandas costs more than a short chain, so that some are walked together; they cannot meet
    days = days.withColumn("chains", F.floor(F.col("chain") / CHAINS))
    asking = e.join(days.select(*key, "chains"), key)

    def take(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        left = {d: n for d, n in zip(have["d"].tolist(), have["n_media"].tolist(), strict=True) if n}
        first = dict(left)
        asks = asks.sort_values("entry_index", kind="stable")
        day, rank = [], []
        for d in asks["d"].tolist():
            at = d + 1 if left.get(d + 1) else d - 1 if left.get(d - 1) else None
            day.append(at)
            rank.append(first[at] - left[at] + 1 if at is not None else None)
            if at is not None:
                left[at] -= 1
        out = asks[["export_id", "kind", "entry_index"]].assign(d=pd.array(day, "Int32"), rank=pd.array(rank, "Int32"))
        return out[out["d"].notna()]

    chain = ["export_id", "kind", "chains"]
    have = days.toDF(*days.columns)  # columns of its own: both sides stem from the same days
    taken = asking.groupBy(*chain).cogroup(have.groupBy(*chain)).applyInPandas(take, "export_id string, kind string, entry_index long, d int, rank int")
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("uuid")))
    return taken.join(ranked, [*key, "rank"]).select("export_id", "entry_index", "uuid")


def duplicates(files: DataFrame, id_col: str = "uuid", role_col: str = "role") -> tuple[DataFrame, DataFrame]:
    """Files that claim one id and role: the first path is kept. Gives the kept files, and (id, role, kept, ignored)."""
    key = ["export_id", id_col, role_col]
    grouped = files.groupBy(*key).agg(F.min_by(F.struct(*[c for c in files.columns if c not in key]), "path").alias("row"), F.array_sort(F.collect_list("path")).alias("paths"))
    kept = grouped.select(*key, "row.*").select(*files.columns)
    again = grouped.filter(F.size("paths") > 1).select(*key, F.element_at("paths", 1).alias("kept"), F.slice("paths", 2, F.size("paths") - 1).alias("ignored"))
    return kept, again


def pair_overlays(files: DataFrame, id_col: str = "uuid", role_col: str = "role") -> tuple[DataFrame, DataFrame]:
    """Main files with the overlay of their id, if there is one; and overlays without a main file."""
    kept, _ = duplicates(files, id_col, role_col)
    main = kept.filter(F.col(role_col) == "main").drop(role_col)
    over = kept.filter(F.col(role_col) == "overlay")
    paired = main.join(over.select("export_id", id_col, F.col("path").alias("overlay_path")), ["export_id", id_col], "left").withColumnRenamed("path", "main_path")
    return paired, over.join(main, ["export_id", id_col], "left_anti")


def pair_chat(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zip files of one id paired as main (media) and overlay; plain files are units of their own.

    files: export_id, path, and the parsed name's day, token, family, id and extension.
    """
    role = F.when((F.col("family") == "zip") & (F.col("token") == "overlay"), "overlay").otherwise("main")
    plain = F.when(F.col("family") == "plain", F.concat_ws("~", F.lit("plain"), "id")).otherwise(F.col("id"))
    paired, orphans = pair_overlays(files.withColumn("role", role).withColumn("unit", plain), "unit")
    return paired.drop("unit"), orphans.drop("unit", "role")


def memory_media(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed memory files, and rows of the listing whose name is no memory's."""
    named = listing.withColumn("m", x.parse_memory_name(F.col("path")))
    good = named.filter("m is not null").select("export_id", "path", "m.*").withColumn("kind", x.kind_of_ext(F.col("extension")))
    return good, named.filter("m is null").drop("m")


def message_tokens(messages: DataFrame) -> DataFrame:
    """A row for each media token of each message: its spelling, its canonical form (null if it has none), its place."""
    spelled = messages.select("export_id", "conversation", "pos", F.posexplode(x.media_tokens(F.col("media_ids"))).alias("token_pos", "spelling"))
    return spelled.withColumn("token", x.history_token(F.col("spelling")))


_FIRST = ("conversation", "pos", "token_pos")


def _first_namer(tokens: DataFrame, key: str, *carry: str) -> DataFrame:
    """For each token the first message that names it: by conversation, place in it, place in the message."""
    return tokens.groupBy("export_id", key).agg(F.min(F.struct(*_FIRST, *carry)).alias("first"))


def token_join(messages: DataFrame, units: DataFrame) -> DataFrame:
    """units with the message that names each first. outcome: no_token for files that no token can name, named or unnamed.

    units: export_id, id, token, family. A minimum per token takes the place of a sort of all namings.
    """
    first = _first_namer(message_tokens(messages).filter("token is not null"), "token").withColumnRenamed("token", "id")
    nameable = (F.col("token") == "b") & (F.col("family") == "plain")
    named = units.join(first, ["export_id", "id"], "left")
    hit = nameable & F.col("first").isNotNull()
    return named.select(*units.columns, F.when(~nameable, "no_token").when(hit, "named").otherwise("unnamed").alias("outcome"), *(F.when(hit, F.col(f"first.{c}")).alias(c) for c in _FIRST))


def missing_tokens(messages: DataFrame, units: DataFrame, scan_gaps: DataFrame | None = None) -> DataFrame:
    """Well-formed tokens without a file, with their first namer's conversation; reason unscanned if a folder of the
    export could not be read, else no_file."""
    first = _first_namer(message_tokens(messages).filter("token is not null"), "token")
    files = units.filter((F.col("token") == "b") & (F.col("family") == "plain")).select("export_id", F.col("id").alias("token"))
    gone = first.join(files, ["export_id", "token"], "left_anti").select("export_id", "token", F.col("first.conversation").alias("conversation"))
    if scan_gaps is None:
        return gone.withColumn("reason", F.lit("no_file"))
    gaps = scan_gaps.select("export_id").distinct().withColumn("gap", F.lit(True))
    return gone.join(gaps, "export_id", "left").withColumn("reason", F.when(F.col("gap"), "unscanned").otherwise("no_file")).drop("gap")


def unparsed_tokens(messages: DataFrame) -> DataFrame:
    """Spellings that are no token, with the conversation that has each first."""
    bad = message_tokens(messages).filter("token is null")
    return _first_namer(bad, "spelling").select("export_id", "spelling", F.col("first.conversation").alias("conversation"))


def history_attribution(messages: DataFrame) -> DataFrame:
    """token and the conversation that names it first."""
    first = _first_namer(message_tokens(messages).filter("token is not null"), "token")
    return first.select("export_id", "token", F.col("first.conversation").alias("conversation"))


def missing_reason(items: DataFrame, scan_gaps: DataFrame, day: Column) -> DataFrame:
    """items with why each has no file: no_date before scan_incomplete before no_media."""
    gaps = scan_gaps.select("export_id").distinct().withColumn("gap", F.lit(True))
    reason = F.when(day.isNull(), "no_date").when(F.col("gap"), "scan_incomplete").otherwise("no_media")
    return items.join(gaps, "export_id", "left").withColumn("reason", reason).drop("gap")


def bucket_agreement(entries: DataFrame) -> DataFrame:
    """day, kind and whether all entries of the bucket name one and the same point, and that point."""
    one = (F.count("lat") == F.count(F.lit(1))) & (F.count("lon") == F.count(F.lit(1))) & (F.min("lat") == F.max("lat")) & (F.min("lon") == F.max("lon"))
    agreed = F.coalesce(one, F.lit(False))
    return entries.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"), agreed.alias("agreed"), F.when(agreed, F.min("lat")).alias("lat"), F.when(agreed, F.min("lon")).alias("lon"))


def permitted_location(items: DataFrame, agreement: DataFrame) -> DataFrame:
    """items with the location each may carry: an exact pair its own, an ambiguous one its bucket's if all agree."""
    shared = agreement.select(*BUCKET, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    exact = F.col("confidence") == "exact"
    joined = items.join(shared, list(BUCKET), "left")
    return joined.withColumn("out_lat", F.when(exact, F.col("lat")).otherwise(F.col("b_lat"))).withColumn("out_lon", F.when(exact, F.col("lon")).otherwise(F.col("b_lon"))).drop("b_lat", "b_lon")


def memory_items(entries: DataFrame, media: DataFrame, scan_gaps: DataFrame) -> DataFrame:
    """One row for each entry: its medium and how surely it is its own, or why it has none.

    source_id is the medium's uuid, or ``unpaired-entry-<index>``. The result of a whole reconciliation of days.
    """
    pairs, left, free = bucket_match(entries.select(*BUCKET, "entry_index"), media.select(*BUCKET, "uuid"), written=True)
    none = F.lit(None).cast("string")
    flat = pairs.select(*BUCKET, "entry.entry_index", "media.uuid", "confidence", none.alias("reason"))
    tried = left.join(adjacent_match(left, free), ["export_id", "entry_index"], "left")
    rest = missing_reason(tried, scan_gaps, F.col("day"))
    found = F.col("uuid").isNotNull()
    rest = rest.select(*BUCKET, "entry_index", "uuid", F.when(found, "ambiguous").otherwise("missing").alias("confidence"), F.when(~found, F.col("reason")).alias("reason"))
    return flat.unionByName(rest).withColumn("source_id", F.coalesce("uuid", F.concat(F.lit("unpaired-entry-"), F.col("entry_index").cast("string"))))


def named_set(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """export_id, source_id and side (item or gap) of all that a run names. items and gaps: export_id, source_id.

    An id on both sides is an error that fails the job: an item with a file cannot lack one.
    """
    key = ["export_id", "source_id"]
    each = items.select(*key, F.lit("item").alias("side")).unionByName(gaps.select(*key, F.lit("gap").alias("side")))
    sides = each.groupBy(*key).agg(F.min("side").alias("low"), F.max("side").alias("high"))
    clash = F.raise_error(F.concat(F.lit("an item and a gap share an id in export "), F.coalesce("export_id", F.lit("null")))).cast("string")
    return sides.select(*key, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(clash).alias("side"))
