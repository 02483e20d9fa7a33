"""Deliveries of personal-data archives as tables: JSON sections, their typed rows, file listings and parts.

A section is read as text and parsed under a schema that is written down here, never inferred. A file that is
absent gives no rows, a file that can't be read gives a row of errors; neither stops the other deliveries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.functions import expr as x

#: The files that a delivery may hold.
SECTION_FILES = (
    "account.json", "account_history.json", "bitmoji.json", "chat_history.json", "custom_sticker.json", "email_campaign_history.json", "feature_emails.json",
    "friends.json", "in_app_reports.json", "location_history.json", "memories_history.json", "ranking.json", "snap_ads.json", "snap_history.json",
    "snap_pro.json", "snapchat_ai.json", "snapchat_plus.json", "story_history.json", "terms_history.json", "user_profile.json",
)


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_VARIANTS = T.ArrayType(T.VariantType())
_MESSAGE = T.StructType([*_texts("From", "Media Type", "Created", "Content", "Conversation Title", "Media IDs").fields, T.StructField("IsSender", T.BooleanType()), T.StructField("Created(microseconds)", T.LongType()), T.StructField("IsSaved", T.BooleanType())])
_FRIEND = _texts("Username", "Display Name", "Creation Timestamp", "Last Modified Timestamp", "Source")
FRIEND_LISTS = ("Friends", "Friend Requests Sent", "Blocked Users", "Deleted Friends", "Hidden Friend Suggestions", "Ignored Snapchatters", "Pending Requests")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _of(pairs: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in pairs.items()])


#: What each parsed file looks like, keys as the archives spell them. Files not listed are kept as variants.
SCHEMAS: dict[str, T.DataType] = {
    "chat_history.json": T.MapType(T.StringType(), T.ArrayType(_MESSAGE)),
    "snap_history.json": T.MapType(T.StringType(), T.ArrayType(_MESSAGE)),
    "memories_history.json": _of({"Saved Media": T.ArrayType(_texts("Date", "Media Type", "Location", "Download Link", "Media Download Url"))}),
    "friends.json": _of({**{n: T.ArrayType(_FRIEND) for n in FRIEND_LISTS}, "Shortcuts": T.ArrayType(_texts("Shortcut Name", "Created"))}),
    "account.json": _of(
        {
            "Basic Information": _texts("Username", "Name", "Creation Date", "Registration IP", "Country", "Last Active"),
            "Device Information": _texts("Make", "Model ID", "Model Name", "Language", "OS Type", "OS Version", "Connection Type"),
            "Device History": T.ArrayType(_texts("Make", "Model", "Start Time", "Device Type")),
            "Privacy Policy and Terms of Service Acceptance History": _VARIANTS,
            "Custom Creative Tools Terms": _VARIANTS,
            "Login History": T.ArrayType(_texts("IP", "Country", "Created", "Status", "Device")),
            "Family Center": _VARIANTS,
            "Associated Accounts by Cloud Account ID": T.ArrayType(_texts("Device ID", "User ID", "Request Time", "Approximate Last Seen")),
        }
    ),
    "user_profile.json": _of(
        {
            "App Profile": _texts("Country", "Creation Time", "Account Creation Country", "Platform Version", "In-app Language"),
            "Demographics": _texts("Cohort Age", "Derived Ad Demographic"),
            "Subscriptions": _VARIANTS,
            "Engagement": T.ArrayType(_struct(Event=T.StringType(), Occurrences=T.LongType())),
            "Discover Channels Viewed": _VARIANTS,
            "Breakdown of Time Spent on App": T.ArrayType(T.StringType()),
            "Ads You Interacted With": _VARIANTS,
            "Interest Categories": _VARIANTS,
            "Content Categories": _VARIANTS,
            "Geographic Information": _VARIANTS,
            "Interactions": _of({"Web Interactions": T.ArrayType(T.StringType()), "App Interactions": _VARIANTS}),
            "Off-Platform Sharing": _VARIANTS,
            "Mobile Ad Id": T.StringType(),
        }
    ),
    "location_history.json": _of(
        {
            "Frequent Locations": T.ArrayType(_texts("City", "Country", "Region")),
            "Latest Location": T.ArrayType(_texts("City", "Country", "Region")),
            "Home, School & Work": T.MapType(T.StringType(), T.StringType()),
            "Daily Top Locations": _VARIANTS,
            "Top Locations Per Six-Day Period": _VARIANTS,
            "Location History": _VARIANTS,
            "Businesses and places you may have visited": T.MapType(T.StringType(), _VARIANTS),
            "Actiomoji information from places you may have visited": _VARIANTS,
            "Areas you may have visited in the last two years": T.ArrayType(_texts("Time", "City", "Region", "Postal Code")),
        }
    ),
    "story_history.json": _of({"Your Story Views": T.ArrayType(_of({"Story Date": T.StringType(), "Story Views": T.LongType(), "Story Replies": T.LongType()})), "Friend and Public Story Views": _VARIANTS}),
    "snapchat_plus.json": _of({"": T.ArrayType(_of({"Purchase Date": T.StringType(), "Purchase Type": T.StringType(), "Purchase Provider": T.StringType(), "Price": T.DoubleType(), "End Date (if applicable)": T.StringType()}))}),
}
#: Fields that hold a moment, by file; others stay texts, whatever they look like.
MOMENTS: dict[str, tuple[str, ...]] = {
    "account.json": ("Creation Date", "Start Time", "Created", "Request Time", "Approximate Last Seen"),
    "user_profile.json": ("Creation Time",),
}


def delivery_of(path: Column) -> Column:
    """The id of the delivery that a path lies in: its innermost folder named like a part."""
    folders = F.filter(F.split(path, "/"), lambda s: F.startswith(s, F.lit(x.PART_PREFIX)) | F.startswith(s, F.lit("mydata%7E")))
    return x.parse_part(F.replace(F.try_element_at(folders, F.lit(-1)), F.lit("%7E"), F.lit("~")))["id"]


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """export_id, file and body of every known JSON file in a ``json`` folder under root, one file a row."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.input_file_name()
    at = raw.select(path.alias("path"), F.col("value").alias("body"))
    known = F.element_at(F.split("path", "/"), -2) == "json"
    return at.filter(known & x.base_name(F.col("path")).isin(*SECTION_FILES)).select(delivery_of(F.col("path")).alias("export_id"), x.base_name(F.col("path")).alias("file"), "body")


#: Fields that may hold null; everywhere else null is another shape than the one that is stated.
NULLABLE = ("Content", "Conversation Title", "Created(microseconds)")
#: Fields that hold counts: whole numbers from 0 on.
COUNTS = ("Story Views", "Story Replies")


#: Spark's words for what a variant is, and the words of the verdicts.
WORDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "VOID": "null"}


def _found(v: Column) -> Column:
    """What a variant is: object, array, string, bool, int, float, null, or other."""
    words = F.create_map(*(F.lit(w) for pair in WORDS.items() for w in pair))
    return F.coalesce(F.try_element_at(words, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)), F.lit("other"))


def _expected(kind: T.DataType, name: str = "") -> str:
    """The word for what a schema states; empty where it states nothing."""
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.LongType):
        return "count" if name in COUNTS else "int"
    return {T.ArrayType: "array", T.StringType: "string", T.BooleanType: "bool", T.DoubleType: "float"}.get(type(kind), "")


def _fitting(word: str, null: bool) -> list[str]:
    """The words of what a place takes that a schema states."""
    return [*({"float": ["float", "int"], "count": ["int"]}.get(word, [word])), *(["null"] if null else [])]


#: How schema_of_variant begins for what each expected word takes; a text that is longer has parameters or parts.
_BEGINS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "bool": ("BOOLEAN",), "int": ("BIGINT",), "count": ("BIGINT",), "float": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "null": ("VOID",)}


def _wrong(v: Column, word: str, null: bool) -> Column:
    """Whether a variant is none of what a place takes; one call and one pattern, as every place of every file has this."""
    fits = "|".join([*_BEGINS[word], *(_BEGINS["null"] if null else ())])
    wrong = ~F.schema_of_variant(v).rlike(f"^({fits})([^A-Z]|\\z)")
    if word == "count":
        return F.coalesce(F.try_variant_get(v, "$", "long") < 0, F.lit(False)) | wrong
    return wrong


def _misshapen(v: Column, kind: T.DataType, name: str = "") -> Column:
    """Whether a variant has another shape than stated, at any depth. Unknown fields and fields that are missing fit."""
    word = _expected(kind, name)
    if not word:
        return F.lit(False)
    wrong = _wrong(v, word, name in NULLABLE)
    if isinstance(kind, T.ArrayType) and _expected(kind.elementType):
        return F.when(wrong, True).otherwise(F.exists(v.cast("array<variant>"), lambda e: _misshapen(e, kind.elementType)))
    if isinstance(kind, T.MapType) and _expected(kind.valueType):
        return F.when(wrong, True).otherwise(F.exists(F.map_values(v.cast("map<string,variant>")), lambda e: _misshapen(e, kind.valueType)))
    if isinstance(kind, T.StructType):

        def bad(e: Column) -> Column:
            """By the fields' rules; fields of one kind without inner rules share a branch."""
            plain: dict[tuple[str, bool], list[str]] = {}
            inner = F.lit(False)
            for f in kind:
                if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)) and _expected(f.dataType):
                    inner = F.when(e["key"] == f.name, _misshapen(e["value"], f.dataType, f.name)).otherwise(inner)
                elif w := _expected(f.dataType, f.name):
                    plain.setdefault((w, f.name in NULLABLE), []).append(f.name)
            for (w, null), names in plain.items():
                inner = F.when(e["key"].isin(*names), _wrong(e["value"], w, null)).otherwise(inner)
            return inner

        return F.when(wrong, True).otherwise(F.exists(F.map_entries(v.cast("map<string,variant>")), bad))
    return wrong


def _nodes(file: str) -> list[tuple[str, str, bool, bool]]:
    """path, expected word, whether null fits, and whether its members share one rule, for all that a file's schema states."""
    out = []

    def add(path: str, kind: T.DataType, name: str) -> None:
        if word := _expected(kind, name):
            out.append((path, word, name in NULLABLE, isinstance(kind, (T.ArrayType, T.MapType))))
        if isinstance(kind, T.StructType):
            for f in kind:
                add(f"{path}/{f.name}", f.dataType, f.name)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            add(f"{path}/*", kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType, "")

    add("", SCHEMAS[file], "")
    return out


def shape_errors(texts: DataFrame) -> DataFrame:
    """export_id, file, path, expected, found and n of whatever in parsed files has another shape than stated.

    texts: export_id, file, body. A path has ``*`` for places in lists and for keys that are data, so that no value and
    no name of a person is in it; n counts the places. Only files that have such an error are walked, a level at a time,
    and only into what the schema states.
    """
    spark = texts.sparkSession
    rules = {(f, path): rest for f in SCHEMAS for path, *rest in _nodes(f)}
    rule = spark.createDataFrame([(f, path, word, _fitting(word, null), shared) for (f, path), (word, null, shared) in rules.items()], "file string, path string, word string, takes array<string>, shared boolean")
    depth = max(path.count("/") for _, path in rules)
    gone = F.lit(None).cast("string")
    rows = misshapen(texts).select("export_id", "file", F.lit("").alias("path"), "v", gone.alias("expected"), gone.alias("found"))
    for level in range(depth + 1):
        # a row for each place that the schemas state; errors of outer levels go along, so that files are read once
        rows = rows.join(F.broadcast(rule), ["file", "path"], "left").withColumn("at", F.when(F.col("expected").isNull() & F.col("word").isNotNull(), _found(F.col("v"))))
        fits = F.array_contains("takes", F.col("at")) & ((F.col("word") != "count") | F.coalesce(F.try_variant_get("v", "$", "long") >= 0, F.lit(False)))
        # bound once: the verdict steers all that follows
        rows = rows.select("export_id", "file", "path", "shared", "v", "expected", "found", "word", F.explode(F.array(F.struct("at", fits.alias("fits")))).alias("j"))
        bad, deeper = F.col("j.at").isNotNull() & ~F.col("j.fits"), F.col("j.fits") & F.col("j.at").isin("object", "array")
        if level == depth:
            deeper = F.lit(False)
        rows = rows.filter(F.col("expected").isNotNull() | bad | deeper).select(
            "export_id", "file", "path", "shared", F.when(bad, F.col("word")).otherwise(F.col("expected")).alias("expected"), F.when(bad, F.col("j.at")).otherwise(F.col("found")).alias("found"), F.when(deeper, F.col("v")).alias("v")
        )
        if level < depth:
            inner = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).toDF("export_id", "file", "path", "shared", "expected", "found", "v", "pos", "key", "value")
            step = F.when(F.col("shared"), "*").otherwise(F.col("key"))
            rows = inner.select("export_id", "file", F.when(F.col("expected").isNotNull(), F.col("path")).otherwise(F.concat("path", F.lit("/"), step)).alias("path"), F.col("value").alias("v"), "expected", "found")
    errors = rows
    return errors.groupBy("export_id", "file", "path", "expected", "found").agg(F.count(F.lit(1)).alias("n"))


def _plain_text(kind: T.DataType, name: str = "") -> str | None:
    """A pattern of what schema_of_variant says of a value without nulls that fits at any depth; null where no such
    pattern is tried: maps, whose keys are data, and counts."""
    if isinstance(kind, T.StructType):
        inner = [(f.name.replace("`", "``"), _plain_text(f.dataType, f.name)) for f in kind]
        fields = "|".join(f"(?:`{re.escape(n)}`|{re.escape(n)}): {s}" for n, s in inner if s)
        return f"OBJECT<(?:(?:{fields})(?:, |(?=>)))*>"
    if isinstance(kind, T.ArrayType):
        element = _plain_text(kind.elementType) if _expected(kind.elementType) else r"[A-Z]+(?:\([0-9,]+\))?"
        return element and f"ARRAY<(?:VOID|{element})>"
    if isinstance(kind, T.DoubleType):
        return r"(?:BIGINT|DECIMAL\([0-9,]+\)|DOUBLE|FLOAT)"
    return {"string": "STRING", "bool": "BOOLEAN", "int": "BIGINT"}.get(_expected(kind, name))


def _judged(e: Column, file: Column, body: Column | None = None) -> Column:
    """Whether a parsed file has another shape than stated. ``e`` is looked at many times and must be bound.

    body: the file's text. Without nulls, which vanish beside other values in the schema of a whole file, that schema tells
    at once that a file fits; only files of which it does not tell are walked.
    """
    out = ~F.schema_of_variant(e).startswith("OBJECT")
    for name, kind in SCHEMAS.items():
        walked = _misshapen(e, kind)
        if body is not None and (plain := _plain_text(kind)):
            walked = F.when(~F.contains(body, F.lit("null")) & F.schema_of_variant(e).rlike(f"^{plain}\\z"), False).otherwise(walked)
        out = F.when(file == name, walked).otherwise(out)
    return out


def _wrong_shape(v: Column, file: Column) -> Column:
    return F.exists(F.array(v), lambda e: _judged(e, file))


def misshapen(texts: DataFrame) -> DataFrame:
    """export_id, file and the parsed ``v`` of files that are JSON of another shape than theirs."""
    rows = texts.select("export_id", "file", x.parse_strict(F.col("body")).alias("v")).filter("v is not null")
    # judged where the file is read, once
    return rows.filter(_wrong_shape(F.col("v"), F.col("file")))


def read_sections(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All known files of every delivery, and errors. texts: export_id, file, body; a null body is a file that could not
    be read.

    sections: export_id, file, state (absent, loaded or broken), body. errors: export_id, file, kind (io, syntax, shape
    or duplicate_key), n_chars. A body is broken if it is no JSON or goes on behind its end, if it holds a key twice, or
    if anything in it, at any depth, has another shape than its file should have (see shape_errors). Fields that the
    schema doesn't name, and lists whose elements it doesn't state, take any shape.
    """
    loose = F.from_json("body", "map<string,string>")
    twice = F.try_parse_json("body").isNull() & (F.size(F.map_keys(loose)) > 0) & F.rtrim("body").endswith("}")
    # parsed once: projections of their own bind what is looked at twice, and a generator keeps filters from copying the verdict
    parsed = texts.select("export_id", "file", "body", x.wrapped_json(F.col("body")).alias("w")).select("export_id", "file", "body", x.only_element(F.col("w")).alias("v"))
    v = F.col("v")
    kind = F.when(F.col("body").isNull(), "io").when(v.isNull(), F.when(twice, "duplicate_key").otherwise("syntax")).when(_judged(v, F.col("file"), F.col("body")), "shape")
    judged = parsed.select("export_id", "file", "body", F.explode(F.array(kind)).alias("kind"))
    present = judged.filter(F.col("export_id").isNotNull() & F.col("file").isin(*SECTION_FILES)).select(
        "export_id", "file", F.when(F.col("kind").isNotNull(), "broken").otherwise("loaded").alias("state"), F.when(F.col("kind").isNull(), F.col("body")).alias("body")
    )
    # apart from the files that are there, so that readers of those need no shuffle
    held = texts.groupBy("export_id").agg(F.collect_set(F.when(F.col("export_id").isNotNull(), F.col("file"))).alias("held"))
    lacking = held.select("export_id", F.explode(F.array_except(F.array(*map(F.lit, SECTION_FILES)), F.col("held"))).alias("file"))
    sections = present.unionByName(lacking.select("export_id", "file", F.lit("absent").alias("state"), F.lit(None).cast("string").alias("body")))
    errors = judged.filter(F.col("kind").isNotNull()).select("export_id", "file", "kind", F.coalesce(F.char_length("body"), F.lit(0)).cast("long").alias("n_chars"))
    return sections, errors


def _loaded(sections: DataFrame, file: str) -> DataFrame:
    rows = sections.filter((F.col("file") == file) & (F.col("state") == "loaded"))
    return rows.select("export_id", F.from_json("body", SCHEMAS[file]).alias("s"))


def _messages(sections: DataFrame, file: str, source: str) -> DataFrame:
    threads = _loaded(sections, file).select("export_id", F.explode("s").alias("conversation", "rows"))
    rows = threads.select("export_id", "conversation", F.posexplode("rows").alias("pos", "m"))
    chat = source == "chat"
    text = lambda key: x.opt_text(F.col(f"m.`{key}`"))
    gone = F.lit(None).cast("string")
    return rows.select(
        "export_id", "conversation", F.lit(source).alias("source"), F.col("pos").cast("long").alias("pos"), text("From").alias("sender"),
        x.media_kind(F.coalesce(F.col("m.`Media Type`"), F.lit(""))).alias("media_type"), x.parse_utc(F.col("m.Created")).alias("created"),
        x.opt_epoch(F.col("m.`Created(microseconds)`")).alias("created_epoch_ms"), (text("Content") if chat else gone).alias("content"),
        text("Conversation Title").alias("title"), F.coalesce("m.IsSender", F.lit(False)).alias("is_sender"),
        (F.coalesce("m.IsSaved", F.lit(False)) if chat else F.lit(None).cast("boolean")).alias("is_saved"), (text("Media IDs") if chat else gone).alias("media_ids"),
        x.validation_error(file, "Created", "timestamp", F.col("m.Created"), x.parse_utc(F.col("m.Created")).isNotNull()).alias("error"),
    )


def chat_messages(sections: DataFrame) -> DataFrame:
    """A row for each chat message; pos counts within its conversation. A key may be empty, a conversation is never null."""
    return _messages(sections, "chat_history.json", "chat")


def snap_messages(sections: DataFrame) -> DataFrame:
    """A row for each snap: as chat messages, without content and media ids."""
    return _messages(sections, "snap_history.json", "snap")


def memory_entries(sections: DataFrame) -> DataFrame:
    """A row for each entry of the memories manifest; entry_index is its place, url the direct or else the indirect link."""
    rows = _loaded(sections, "memories_history.json").select("export_id", F.posexplode(F.col("s.`Saved Media`")).alias("i", "m"))
    # bound once: copies in all columns that look at them make a method of over 8000 bytes, which the JVM does not compile
    lat, lon = x.location_numbers(F.col("m.Location"))
    rows = rows.select("export_id", "i", "m", x.parse_utc(F.col("m.Date")).alias("date"), lat.alias("lat"), lon.alias("lon"))
    date, where = F.col("date"), x.split_location(F.col("m.Location"), F.col("lat"), F.col("lon"))
    # a text that is a moment begins with its day
    day = F.when(date.isNotNull(), F.left("m.Date", F.lit(10)))
    return rows.select(
        "export_id", F.col("i").cast("long").alias("entry_index"), "date", day.alias("day"), x.kind_of_word(F.col("m.`Media Type`")).alias("kind"),
        where["point"]["lat"].alias("lat"), where["point"]["lon"].alias("lon"), where["place"].alias("place"), F.coalesce(x.opt_text(F.col("m.`Media Download Url`")), x.opt_text(F.col("m.`Download Link`"))).alias("url"),
        F.coalesce(x.validation_error("memories_history.json", "Date", "timestamp", F.col("m.Date"), date.isNotNull()), x.validation_error("memories_history.json", "Location", "coordinates", F.col("m.Location"), ~where["bad"])).alias("error"),
    )


def table_errors(rows: DataFrame) -> DataFrame:
    """The validation errors of typed rows, one for each row that has one."""
    return rows.filter(F.col("error").isNotNull()).select("export_id", "error.*")


def fail_on_errors(errors: DataFrame) -> None:
    """Raise if there are errors; the message counts them by file and kind and holds no value."""
    counts = errors.groupBy("file", "kind").count().orderBy("file", "kind").limit(50).collect()
    if counts:
        raise ValueError("invalid deliveries: " + ", ".join(f"{r.file} {r.kind}: {r['count']}" for r in counts))


def _snake(name: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in name.lower().replace("&", "and")).split()
    return "_".join(words) or "blank"


def _typed(file: str, fields: list[tuple[T.StructField, Column, str]]) -> list[Column]:
    """Columns of fields (field, value, name of the column): empty texts are null, moments are structs of six numbers,
    and ``error`` is the first moment that is none."""
    out, errors = [], []
    for f, value, name in fields:
        if f.name in MOMENTS.get(file, ()):
            moment = x.parse_utc(value)
            out.append(moment.alias(name))
            errors.append(x.validation_error(file, f.name, "timestamp", value, moment.isNotNull()))
        else:
            out.append((x.opt_text(value) if isinstance(f.dataType, T.StringType) else value).alias(name))
    return [*out, F.coalesce(*errors).alias("error")] if errors else out


def _child(parsed: DataFrame, file: str, field: str, kind: T.DataType) -> DataFrame:
    rows = parsed.select("export_id", F.posexplode(F.col(field)).alias("pos", "r"))
    if isinstance(kind, T.StructType):
        return rows.select("export_id", "pos", *_typed(file, [(f, F.col(f"r.`{f.name}`"), _snake(f.name)) for f in kind]))
    return rows.select("export_id", "pos", F.col("r").alias("value"))


def _tables(sections: DataFrame, file: str) -> dict[str, DataFrame]:
    """A table for the fields of a file that occur once, and one for each of its lists and maps."""
    parsed = _loaded(sections, file)
    out: dict[str, DataFrame] = {}
    flat: list[tuple[T.StructField, Column, str]] = []

    def add(f: T.StructField, at: str, prefix: str) -> None:
        name = prefix + _snake(f.name)
        if isinstance(f.dataType, T.ArrayType):
            out[name] = _child(parsed, file, at, f.dataType.elementType)
        elif isinstance(f.dataType, T.MapType):
            out[name] = parsed.select("export_id", F.explode(F.col(at)).alias("key", "value"))
        elif isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                add(g, f"{at}.`{g.name}`", f"{name}__")
        else:
            flat.append((f, F.col(at), name))

    for f in SCHEMAS[file]:
        add(f, f"s.`{f.name}`", "")
    if flat:
        out["basics"] = parsed.select("export_id", *_typed(file, flat))
    return out


def account_tables(sections: DataFrame) -> dict[str, DataFrame]:
    """basics, device_history, login_history, the associated accounts, and the lists that are not modelled. Moments
    are structs of six numbers; ``error`` tells of one that is none."""
    return _tables(sections, "account.json")


def profile_tables(sections: DataFrame) -> dict[str, DataFrame]:
    """basics with the number of subscriptions, and a table for each list. The creation time is a struct of six
    numbers; ``error`` tells if it is none."""
    out = _tables(sections, "user_profile.json")
    counted = _loaded(sections, "user_profile.json").select("export_id", F.coalesce(F.size("s.Subscriptions"), F.lit(0)).alias("n_subscriptions"))
    return out | {"basics": out["basics"].join(counted, "export_id")}


def location_tables(sections: DataFrame) -> dict[str, DataFrame]:
    """A table for each of the nine lists and maps of places; their dates are texts of no fixed form."""
    return _tables(sections, "location_history.json")


def story_views(sections: DataFrame) -> DataFrame:
    """The owner's stories: pos, story_date (a text of no fixed form), story_views and story_replies."""
    return _tables(sections, "story_history.json")["your_story_views"]


def subscriptions(sections: DataFrame) -> DataFrame:
    """Purchases of the paid tier, which the archive keeps under an empty key."""
    return _tables(sections, "snapchat_plus.json")["blank"]


def friends_long(sections: DataFrame) -> DataFrame:
    """All relations of all lists in one table; ``list`` names the list, shortcuts have a name and a date only.

    created and modified are structs of six numbers; ``error`` tells of the first of them that is none.
    """
    file = "friends.json"
    parsed = _loaded(sections, file)
    row = lambda **c: F.struct(*(c.get(n, F.lit(None).cast("string")).alias(n) for n in ("username", "display_name", "created", "modified", "origin")))
    lists = [F.struct(F.lit(_snake(n)).alias("list"), F.transform(F.col(f"s.`{n}`"), lambda r: row(username=x.opt_text(r["Username"]), display_name=x.opt_text(r["Display Name"]), created=r["Creation Timestamp"], modified=r["Last Modified Timestamp"], origin=x.opt_text(r["Source"]))).alias("rows")) for n in FRIEND_LISTS]
    lists.append(F.struct(F.lit("shortcuts").alias("list"), F.transform(F.col("s.Shortcuts"), lambda r: row(display_name=x.opt_text(r["Shortcut Name"]), created=r["Created"])).alias("rows")))
    each = parsed.select("export_id", F.explode(F.array(*lists)).alias("l")).select("export_id", "l.list", F.posexplode("l.rows").alias("pos", "r"))
    created, modified = x.parse_utc(F.col("r.created")), x.parse_utc(F.col("r.modified"))
    wrong = lambda field, text, moment: x.validation_error(file, field, "timestamp", text, moment.isNotNull())
    error = F.coalesce(wrong("Creation Timestamp", F.col("r.created"), created), wrong("Last Modified Timestamp", F.col("r.modified"), modified))
    return each.select("export_id", "list", "pos", "r.username", "r.display_name", created.alias("created"), modified.alias("modified"), "r.origin", error.alias("error"))


def passthrough(sections: DataFrame, file: str) -> DataFrame:
    """A file that is kept but not modelled, as one variant for each delivery."""
    rows = sections.filter((F.col("file") == file) & (F.col("state") == "loaded"))
    return rows.select("export_id", "file", F.try_parse_json("body").alias("value"))


# ---- files ----


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modification time of all files under root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def media_listing(listing: DataFrame, dir_name: str) -> DataFrame:
    """Files that lie directly in a folder of that name, at any depth. listing: path, and export_id if it is known."""
    folder = F.element_at(F.filter(F.split("path", "/"), lambda s: s != ""), -2)
    export = F.col("export_id") if "export_id" in listing.columns else delivery_of(F.col("path"))
    return listing.filter(folder == dir_name).select(export.alias("export_id"), "path", x.base_name(F.col("path")).alias("name"))


def delivery_parts(paths: DataFrame) -> DataFrame:
    """id, and the sorted numbers of its parts seen as archives and as folders. paths: path of each."""
    stem = F.regexp_replace(x.base_name(F.regexp_replace("path", "/+$", "")), r"(?i)\.zip$", "")
    # bound in steps: the part's rules look at the stem many times
    stems = paths.select(F.explode(F.array(stem)).alias("stem"), F.lower("path").endswith(".zip").alias("zipped"))
    rows = stems.select(F.explode(F.array(x.parse_part(F.col("stem")))).alias("p"), "zipped").filter("p is not null")
    seen = lambda z: F.sort_array(F.collect_set(F.when(F.col("zipped") == z, F.col("p.number"))))
    return rows.groupBy(F.col("p.id").alias("id")).agg(seen(True).alias("zips"), seen(False).alias("folders"))
