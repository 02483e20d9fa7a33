"""Pseudonymised copies of JSON corpora, and the search for what leaked into them.

Draws come from SHA-256 of a seed, a place and a purpose: the same corpus and seed give the same copy, however the
rows are dealt to tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.sources.tables import cut

# Normal forms of keys whose values join rows, keys of coordinates, and signs of keys of free text.
USER_KEYS = (
    "username", "user", "userid", "from", "to", "sender", "recipient", "recipients", "participant", "participants", "friend", "handle", "screenname", "displayname", "addedby",
)
CONVERSATION_KEYS = ("conversationid", "conversationtitle", "conversation", "chatid", "groupid", "threadid")
ID_KEYS = ("id", "mediaid", "messageid", "snapid", "memoryid", "externalid", "uuid", "guid")
COORDINATE_KEYS = ("lat", "latitude", "lon", "lng", "long", "longitude", "coord", "coords", "coordinate", "coordinates", "latlon", "latlng", "geo")
FREE_TEXT = "name|user|display|nick|title|caption|content|text|message|subject|note|bio|description|comment|address|email|phone"
STATE_KEYS = ("type", "status", "state", "kind")
# Words, endings, parameters and labels that say nothing about a person.
ENUM_WORDS = (
    "PHOTO", "VIDEO", "VIDEO_NO_SOUND", "IMAGE", "AUDIO", "AUDIO_NOTE", "TEXT", "MEDIA", "STICKER", "NOTE", "SNAP", "STATUS", "LOCATION", "SHARE", "GIF", "BITMOJI", "SENT", "RECEIVED", "DELIVERED", "VIEWED", "SCREENSHOT", "SAVED",
    "UNSAVED", "DELETED", "PENDING", "EXPIRED", "OPENED", "REPLAYED", "TRUE", "FALSE", "NONE", "NULL", "UNKNOWN", "OTHER", "PUBLIC", "PRIVATE", "FRIENDS", "EVERYONE", "CUSTOM",
)
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "mp4", "mov", "m4v", "avi", "webm", "mp3", "m4a", "aac", "ogg", "opus", "wav", "json", "txt", "html", "csv", "zip", "vcf")
KNOWN_PARAMS = ("uid", "sid", "mid", "cid", "sig", "signature", "policy", "key", "token", "hash", "type", "mo", "ttl", "expires", "expiry", "t", "e", "v", "id", "dmd", "media", "format")
FILE_WORDS = (
    "media", "overlay", "overlays", "thumbnail", "thumbnails", "metadata", "main", "zip", "part", "mydata", "image", "video", "audio", "note", "sticker", "account", "history", "chat", "snap", "snaps", "story", "stories", "memories",
    "friends", "location", "ranking", "shared", "subscriptions", "support", "talk", "terms", "user", "profile", "index", "community", "lenses", "connected", "apps", "purchase", "reports", "app", "in", "with", "json", "html", "files",
    "data", "bitmoji", "custom", "email", "emails", "campaign", "feature", "ads", "pro", "ai", "plus",
)
PLACE_LABELS = ("latitude, longitude:", "latitude,longitude:", "lat, lon:", "lat,lon:", "lat, long:", "lat,long:", "latitude:", "longitude:", "location:", "coordinates:", "coordinate:")

# Files whose keys at the top are names of people, and labels among those keys that are not.
KEYED_FILES = ("chat_history.json", "snap_history.json", "talk_history.json")
SCHEMA_LABELS = (
    "received saved chat history", "sent saved chat history", "received chat history", "sent chat history", "received snap history", "sent snap history", "saved media", "saved chat history", "chat history", "snap history",
    "talk history", "conversations", "messages", "basic information", "device information", "frequent locations", "latest location", "friends", "deleted friends", "blocked users", "hidden friend suggestions",
    "your subscriptions", "your stories", "shared stories",
)
ZERO_UUID = "00000000-0000-0000-0000-000000000000"

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
DATES = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:([ T])([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?(\s*(?:UTC|GMT|Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
YEAR_FIRST, YEAR_LAST = r"^([0-9]{4})/([0-9]{2})/([0-9]{2})\z", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})\z"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
LABELLED = r"^((?i:" + "|".join(PLACE_LABELS) + r")\s*|)([+-]?[0-9]{1,3}\.[0-9]+)(\s*,\s*)([+-]?[0-9]{1,3}\.[0-9]+)\z"
URL_IN_TEXT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'\\<>]+"""
PAIR_IN_TEXT = r"(?i:latitude, longitude:\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*,\s*[+-]?[0-9]+(?:\.[0-9]+)?)|[+-]?[0-9]{1,3}\.[0-9]+\s*,\s*[+-]?[0-9]{1,3}\.[0-9]+"
PAIR_END = r"([+-]?[0-9]+(?:\.[0-9]+)?)\s*,\s*([+-]?[0-9]+(?:\.[0-9]+)?)\z"
MAX_RUN = 12
#: Levels of JSON that one plan opens.
CUT = 6
#: A step into a container: the key of an object or the place in an array, and the prefix of the handle that takes the
#: key's place, if a rule masks it.
STEPS = "array<struct<name:string,at:int,mask:string>>"
#: Masking rules that one plan takes.
MAX_RULES = 1000


@dataclass(frozen=True)
class MaskRule:
    """Objects whose keys are data: ``FILE:/pointer`` or ``/pointer`` for any file, where ``*`` is any step (or any part
    of the file's name) and ``/`` the document itself. A built-in rule leaves known labels, another one masks all."""

    text: str
    builtin: bool = False

    def __post_init__(self) -> None:
        if not self.pointer.startswith("/"):
            raise ValueError(f"{self.text!r}: a rule is /pointer or FILE:/pointer")

    @property
    def file_glob(self) -> str:
        return "*" if self.text.startswith("/") else self.text.split(":", 1)[0]

    @property
    def pointer(self) -> str:
        return self.text if self.text.startswith("/") else self.text.partition(":")[2]

    def covers(self, file: Column, pointer: Column) -> Column:
        steps = "" if self.pointer == "/" else "/".join("[^/]*" if s == "*" else re.escape(s) for s in self.pointer.split("/"))
        name = ".*".join(re.escape(p) for p in self.file_glob.split("*"))
        return file.rlike(rf"(?s)^{name}\z") & pointer.rlike(rf"(?s)^{steps}\z")


BUILTIN_RULES = tuple(MaskRule(f"{f}:/", builtin=True) for f in KEYED_FILES)


# ---- leaves ----


def escaped(key: Column) -> Column:
    """A key as a step of a pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def levels(body: Column) -> Column:
    """How deep the containers of a JSON text are nested; 0 for a plain value or none."""
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.when(c.isin("[", "{"), F.struct((acc["at"] + 1).alias("at"), F.greatest(acc["most"], acc["at"] + 1).alias("most"))).otherwise(F.struct((acc["at"] - F.when(c == "", 0).otherwise(1)).alias("at"), acc["most"].alias("most")))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def _mask(rules: Sequence[MaskRule], file: Column, pointer: Column, key: Column) -> Column:
    """The prefix of the handle that masks a key of the object at pointer: ``key`` by a rule of the user's, ``user`` by a
    built-in one, null for a key that stays."""
    met = lambda builtin: reduce(lambda a, b: a | b, [r.covers(file, pointer) for r in rules if r.builtin == builtin], F.lit(False))
    label = F.array_join(F.filter(F.split(F.lower(key), r"\s+"), lambda w: w != ""), " ")
    return F.when(met(False), "key").when(met(True) & ~label.isin(*SCHEMA_LABELS), "user")


def leaves(spark: SparkSession, corpus: DataFrame, depth: int = 0, rules: Sequence[MaskRule] = BUILTIN_RULES) -> DataFrame:
    """A row for each leaf of each document: export_id, file, pointer, key, parent_key, kind, value, steps.

    corpus: export_id, file, body (JSON text). An element of an array has its array's key. All levels are opened: the
    deepest one is found first, and depth levels at least are gone through; empty containers are leaves, of kind nested.
    pointer and steps hold the keys as they are; steps tell which of them the rules mask (a step that is masked is met by
    ``*`` alone), and synthesise puts handles in their place. A number beyond doubles is an error.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    empty = F.lit("")
    rows = corpus.select("export_id", "file", x.parse_strict(F.col("body")).alias("v"), empty.alias("pointer"), empty.alias("key"), empty.alias("parent_key"), F.array().cast(STEPS).alias("steps"), empty.alias("place"), F.lit(True).alias("open")).filter("v is not null")
    deepest = corpus.filter(x.parse_strict(F.col("body")).isNotNull()).agg(F.max(levels(F.col("body")))).first()[0] or 0
    for level in range(max(depth, deepest)):
        if level and level % CUT == 0:
            rows = cut(rows, "leaves")  # Spark's optimizer does not come through plans of many levels
        inner = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()), how="left")
        inner = inner.toDF("export_id", "file", "v", "pointer", "key", "parent_key", "steps", "place", "open", "pos", "key_", "value")
        went, named = F.col("pos").isNotNull(), F.col("pos").isNotNull() & F.col("key_").isNotNull()
        inner = inner.withColumn("mask", F.when(named, _mask(rules, F.col("file"), F.col("place"), F.col("key_")))) if rules else inner.withColumn("mask", F.lit(None).cast("string"))
        step = F.coalesce(escaped(F.col("key_")), F.col("pos").cast("string"))
        one = F.struct(F.col("key_").alias("name"), F.when(~named, F.col("pos")).cast("int").alias("at"), F.col("mask"))
        # no step of a rule is spelt like a masked one, which holds an escape that no pointer has
        hidden = F.when(F.col("mask").isNotNull(), "~").otherwise(step)
        rows = inner.select(
            "export_id", "file", F.when(went, F.col("value")).otherwise(F.col("v")).alias("v"), F.when(went, F.concat("pointer", F.lit("/"), step)).otherwise(F.col("pointer")).alias("pointer"),
            F.when(named, F.col("key_")).otherwise(F.col("key")).alias("key"), F.when(named, F.col("key")).otherwise(F.col("parent_key")).alias("parent_key"),
            F.when(went, F.concat("steps", F.array(one))).otherwise(F.col("steps")).cast(STEPS).alias("steps"), F.when(went, F.concat("place", F.lit("/"), hidden)).otherwise(F.col("place")).alias("place"), went.alias("open"),
        )
    schema = F.schema_of_variant("v")
    kind = F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "bool").when(schema == "STRING", "string").when(schema == "BIGINT", "int").when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").otherwise("nested")
    text = F.when(kind == "nested", F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
    beyond = (kind == "float") & text.isin("Infinity", "-Infinity", "NaN")
    text = F.when(beyond, F.raise_error(F.concat(F.lit("a number beyond doubles: "), "file")).cast("string")).otherwise(text)
    return rows.select("export_id", "file", "pointer", "key", "parent_key", kind.alias("kind"), text.alias("value"), "steps")


def pointer_of(steps: Column) -> Column:
    """The pointer that steps spell."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("/"), F.coalesce(escaped(s["name"]), s["at"].cast("string")))), "")


def containers(rows: DataFrame) -> DataFrame:
    """export_id, file and place of every object of each document; the place is its pointer with ~ for masked steps."""
    spelt = lambda part: F.array_join(F.transform(part, lambda s: F.concat(F.lit("/"), F.when(s["mask"].isNotNull(), F.lit("~")).otherwise(F.coalesce(escaped(s["name"]), s["at"].cast("string"))))), "")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size("steps") - 1), lambda i: (i >= 0) & F.get("steps", i)["name"].isNotNull()), lambda i: spelt(F.slice("steps", 1, i)))
    own = F.when((F.col("kind") == "nested") & (F.col("value") == "{}"), F.array(spelt(F.col("steps")))).otherwise(F.array().cast("array<string>"))
    each = F.when(F.size("steps") > 0, F.concat(above, own)).otherwise(own)
    return rows.select("export_id", "file", F.explode(each).alias("place")).distinct()


def unused_rules(rows: DataFrame, rules: Sequence[MaskRule]) -> list[str]:
    """The user's rules that cover no object of a corpus: mistakes, as their keys would stay in clear."""
    mine = [r for r in rules if not r.builtin]
    if not mine:
        return []
    met = containers(rows).agg(*(F.coalesce(F.bool_or(r.covers(F.col("file"), F.col("place"))), F.lit(False)).alias(f"r{i}") for i, r in enumerate(mine))).first()
    return [r.text for r, hit in zip(mine, met, strict=True) if not hit]


def require_used(rows: DataFrame, rules: Sequence[MaskRule]) -> None:
    """Raise if a rule of the user's covers nothing."""
    if idle := unused_rules(rows, rules):
        raise ValueError(f"rules that cover no object: {idle}")


def duplicate_keys(corpus: DataFrame) -> DataFrame:
    """Documents that hold a key twice: strict parsing fails, lenient parsing does not."""
    lenient = F.from_json("body", "map<string,string>", {"mode": "PERMISSIVE"})
    return corpus.filter(F.try_parse_json("body").isNull() & (F.size(F.map_keys(lenient)) > 0) & F.rtrim("body").endswith("}")).select("export_id", "file")


def sample_arrays(rows: DataFrame, n: int) -> DataFrame:
    """Elements below n of exploded arrays (pos counts from 0), with the true length; n = 0 keeps all.

    rows: export_id, file, pointer of the array, pos and other columns.
    """
    sizes = rows.groupBy("export_id", "file", "pointer").agg(F.count(F.lit(1)).alias("length"))
    kept = rows if n == 0 else rows.filter(F.col("pos") < n)
    return kept.join(sizes, ["export_id", "file", "pointer"])


# ---- classes ----


def normal_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def join_class(key: Column) -> Column:
    """user, conv or id for keys whose values join rows, else null."""
    k = normal_key(key)
    return F.when(k.isin(*USER_KEYS), "user").when(k.isin(*CONVERSATION_KEYS), "conv").when(k.isin(*ID_KEYS), "id")


def value_class(value: Column, key: Column) -> Column:
    """What a text is: the first that fits of a fixed order. A join key's URL, date or
    place keeps its own class; a uuid there is a value that joins."""
    dated = value.rlike(DATES) | value.rlike(YEAR_FIRST) | value.rlike(YEAR_LAST)
    formatted = value.rlike(URL) | dated | value.rlike(LABELLED)
    name = normal_key(key)
    free = name.rlike(FREE_TEXT) & ~name.rlike(f"({'|'.join(STATE_KEYS)})\\z")
    return (
        F.when(value == "", "empty").when(join_class(key).isNotNull() & ~formatted, "join").when(value.isin(*ENUM_WORDS) & ~free, "enum").when(value.rlike(URL), "url")
        .when(value.rlike(LABELLED), "latlon").when(dated, "datetime").when(value.rlike(UUID), "uuid").when(F.lower(F.ltrim(value, F.lit("."))).isin(*EXTENSIONS), "extension")
        .when(value.rlike(r"^[^/\\\s]+\.(?i:" + "|".join(EXTENSIONS) + r")\z"), "filename").when(value.rlike(r"^[0-9]+\z"), "digits").otherwise("generic")
    )


# ---- draws and replacements ----


def draw(seed: str, purpose: str, *place: Column) -> Column:
    """64 hex digits that seed, purpose and place decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), F.lit(purpose), *place), 256)


def draw_int(hex_digits: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1 from the first 13 of some hex digits."""
    return F.pmod(F.conv(F.left(hex_digits, F.lit(13)), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def shift_date(value: Column, seconds: int) -> Column:
    """A date or time moved by an offset, in its own shape (year first or last, with dashes or slashes, any zone); null
    for what no calendar has. Fractions are redrawn by mirroring their digits."""
    part = lambda i: F.regexp_extract(value, DATES, i)
    moment = lambda y, m, d, time: F.try_to_timestamp(F.concat(y, F.lit("-"), m, F.lit("-"), d, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss"))
    moved = lambda t: F.timestamp_seconds(F.unix_seconds(t) + F.lit(seconds))
    dated = part(4) == ""
    at = moved(moment(part(1), part(2), part(3), F.when(dated, "00:00:00").otherwise(F.concat(part(5), F.lit(":"), part(6), F.lit(":"), part(7)))))
    fraction = F.when(part(8) != "", F.concat(F.lit("."), F.translate(part(8), "0123456789", "9876543210"))).otherwise("")
    out = F.concat(F.date_format(at, "yyyy-MM-dd"), F.when(dated, "").otherwise(F.concat(part(4), F.date_format(at, "HH:mm:ss"), fraction, part(9))))
    midnight = F.lit("00:00:00")
    first = moved(moment(*(F.regexp_extract(value, YEAR_FIRST, i) for i in (1, 2, 3)), midnight))
    last = moved(moment(*(F.regexp_extract(value, YEAR_LAST, i) for i in (3, 1, 2)), midnight))
    return F.when(value.rlike(DATES), out).when(value.rlike(YEAR_FIRST), F.date_format(first, "yyyy/MM/dd")).when(value.rlike(YEAR_LAST), F.date_format(last, "MM/dd/yyyy"))


def shift_epoch(value: Column, seconds: int) -> Column:
    """An epoch of 10, 13, 16 or 19 digits from 1.0e9 to 2.1e9 seconds moved in its own unit; other texts are null."""
    unit = F.when(F.length(value) == 10, 1).when(F.length(value) == 13, 1000).when(F.length(value) == 16, 1000000).when(F.length(value) == 19, 1000000000).cast("long")
    n = F.when(value.rlike(r"^[0-9]{10,19}\z"), value.try_cast("long"))
    whole = F.floor(n / unit.cast("decimal(20,0)"))
    return F.when(unit.isNotNull() & whole.between(1_000_000_000, 2_100_000_000), F.try_add(n, F.lit(seconds).cast("long") * unit).cast("string"))


def fake_coordinate(value: Column, digest: Column) -> Column:
    """A number from 1 to 2 with as many decimals as the value, without its sign."""
    decimals = F.length(F.regexp_extract(value, r"\.([0-9]+)", 1))
    digits = F.translate(F.left(digest, decimals), "abcdef", "012345")
    return F.when(decimals == 0, F.lit("1")).otherwise(F.concat(F.lit("1."), digits))


def is_coordinate(key: Column, parent_key: Column) -> Column:
    return normal_key(key).isin(*COORDINATE_KEYS) | normal_key(parent_key).isin(*COORDINATE_KEYS)


def redact_latlon(value: Column, digest: Column) -> Column:
    """A pair of degrees, with one of the known labels or none, that keeps its label and its numbers of decimals."""
    label, lat, between, lon = (F.regexp_extract(value, LABELLED, i) for i in (1, 2, 3, 4))
    return F.when(value.rlike(LABELLED), F.concat(label, fake_coordinate(lat, digest), between, fake_coordinate(lon, F.reverse(digest))))


def redact_url(value: Column, known_hosts: tuple[str, ...] = ()) -> Column:
    """Scheme, known host and known parameter names stay; everything else is REDACTED or a host of no one's."""
    host = F.lower(F.regexp_extract(value, URL, 2))
    query = F.regexp_extract(value, URL, 4)
    kept = F.when(host.isin(*known_hosts), host).otherwise("redacted.invalid") if known_hosts else F.lit("redacted.invalid")
    pair = lambda p: F.concat(F.when(F.substring_index(p, "=", 1).isin(*KNOWN_PARAMS), F.substring_index(p, "=", 1)).otherwise("REDACTED"), F.when(F.contains(p, F.lit("=")), "=REDACTED").otherwise(""))
    return F.when(
        value.rlike(URL),
        F.concat(
            F.lower(F.regexp_extract(value, URL, 1)), F.lit("://"), kept, F.when(F.regexp_extract(value, URL, 3).isin("", "/"), F.regexp_extract(value, URL, 3)).otherwise("/REDACTED"),
            F.when(query != "", F.concat(F.lit("?"), F.array_join(F.transform(F.split(query, "&"), pair), "&"))).otherwise(""), F.when(F.regexp_extract(value, URL, 5) != "", "#REDACTED").otherwise(""),
        ),
    )


def redact_filename(value: Column, seconds: int = 0) -> Column:
    """A file name whose words are known ones or runs of x (12 at most), with uuids zeroed and dates moved."""
    token = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"
    piece = lambda t: (
        F.when(t.rlike(UUID), F.lit("00000000-0000-0000-0000-000000000000")).when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.coalesce(shift_date(t, seconds), F.lit("xxxx-xx-xx")))
        .when(F.lower(t).isin(*FILE_WORDS, *EXTENSIONS), t).when(t.rlike(r"^[._~-]+\z"), t).otherwise(F.left(F.repeat(F.lit("x"), F.least(F.length(t), F.lit(MAX_RUN))), F.lit(MAX_RUN)))
    )
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(token), F.lit(1)), piece), "")


def redact_int(value: Column, digest: Column) -> Column:
    """A whole number with the same sign and number of digits; 0 stays."""
    digits = F.regexp_replace(value, "^-", "")
    fresh = F.translate(F.left(digest, F.length(digits)), "abcdef", "123456")
    lead = F.concat(F.greatest(F.left(fresh, F.lit(1)), F.lit("1")), F.substring(fresh, 2, 64))
    return F.when(digits.rlike("^0+$"), value).otherwise(F.concat(F.when(value.startswith("-"), "-").otherwise(""), lead))


def redact_float(value: Column, digest: Column) -> Column:
    """A decimal number with the same sign, whole digits and decimals."""
    whole, decimals = F.regexp_extract(value, r"^-?([0-9]+)", 1), F.regexp_extract(value, r"\.([0-9]+)", 1)
    part = F.when(whole == "0", "0").otherwise(redact_int(whole, digest))
    return F.concat(F.when(value.startswith("-"), "-").otherwise(""), part, F.when(decimals != "", F.concat(F.lit("."), F.translate(F.left(F.reverse(digest), F.length(decimals)), "abcdef", "012345"))).otherwise(""))


def generic_tag(digest: Column) -> Column:
    """``redacted-`` and six characters."""
    return F.concat(F.lit("redacted-"), F.left(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(6)))


# ---- pseudonyms ----


def handles(values: DataFrame, seed: str, digits: int = 4) -> DataFrame:
    """value, cls and a dense handle ``cls_n`` for each distinct value; numbers run by class, in order of keyed digests.

    values: value, cls. A value of several classes takes the least class. Numbers come from counts of digest
    prefixes and places within a prefix, so no task sorts all values.
    """
    one = values.filter("value is not null").groupBy("value").agg(F.min("cls").alias("cls")).withColumn("digest", draw(seed, "handle", F.col("value")))
    one = one.withColumn("prefix", F.left("digest", F.lit(digits)))
    counts = one.groupBy("cls", "prefix").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("cls", "prefix").orderBy("digest", "value"))
    numbered = one.withColumn("k", within).join(offsets, ["cls", "prefix"])
    return numbered.select("value", "cls", F.concat("cls", F.lit("_"), (F.col("offset") + F.col("k")).cast("string")).alias("handle"))


def stand_in_uuid(value: Column, seed: str) -> Column:
    """A uuid that seed and value decide: equal values have equal ones, in any file and at any place."""
    d = draw(seed, "uuid", F.lower(value))
    return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))


def stand_in_number(value: Column, seed: str, rounds: int = 4) -> Column:
    """A whole number with the value's sign and digits, that seed and value decide.

    Different values never share one, however narrow they are: the numbers of a width are permuted. A number is a pair
    (left, right), and rounds add to one half what seed, round and the other half draw, modulo the half's size.
    """
    digits = F.regexp_replace(value, "^-", "")
    n = F.length(digits)
    big = lambda c: c.cast("decimal(38,0)")
    # of one digit: 0 to 9; of more: those without a leading 0
    low = F.when(n == 1, big(F.lit(0))).otherwise(big(F.rpad(F.lit("1"), n, "0")))
    right_size = big(F.rpad(F.lit("1"), F.floor((n - 1) / 2).cast("int") + 1, "0"))
    left_size = F.when(n == 1, big(F.lit(10))).otherwise(big(F.lit(9) * big(F.rpad(F.lit("1"), n - F.floor((n - 1) / 2).cast("int"), "0"))))
    at = big(big(digits) - low)
    pair = lambda left, right: F.struct(big(left).alias("left"), big(right).alias("right"))
    start = pair((at - at % right_size) / right_size, at % right_size)
    drawn = lambda i, half: big(F.conv(F.left(draw(seed, "number", i.cast("string"), n.cast("string"), half.cast("string")), F.lit(13)), 16, 10))
    turn = lambda p, i: F.when(i % 2 == 0, pair((p["left"] + drawn(i, p["right"])) % left_size, p["right"])).otherwise(pair(p["left"], (p["right"] + drawn(i, p["left"])) % right_size))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda p: p)
    out = big(low + end["left"] * right_size + end["right"]).cast("string")
    return F.when(digits.rlike("^[0-9]{1,19}$"), F.concat(F.when(value.startswith("-"), "-").otherwise(""), out))


def _masked_steps(rows: DataFrame, given: DataFrame, seed: str) -> DataFrame:
    """rows with handles in the place of masked keys, in steps and in pointer. given: value, handle."""
    hidden = F.array_distinct(F.transform(F.filter("steps", lambda s: s["mask"].isNotNull()), lambda s: s["name"]))
    rows = rows.withColumn("hidden", hidden)
    most = rows.agg(F.max(F.size("hidden"))).first()[0] or 0
    for i in range(most):
        one = given.select(F.col("value").alias(f"v{i}"), F.col("handle").alias(f"h{i}"))
        rows = rows.join(one, F.get("hidden", F.lit(i)) == F.col(f"v{i}"), "left").drop(f"v{i}")
    if not most:
        return rows.drop("hidden")
    names = F.array(*(F.col(f"h{i}") for i in range(most)))
    name = lambda s: F.when(s["mask"].isNull(), s["name"]).when(s["name"].rlike(UUID), stand_in_uuid(s["name"], seed)).otherwise(F.get(names, (F.array_position("hidden", s["name"]) - 1).cast("int")))
    steps = F.transform("steps", lambda s: F.struct(name(s).alias("name"), s["at"].alias("at"), s["mask"].alias("mask"))).cast(STEPS)
    return rows.withColumn("steps", steps).withColumn("pointer", pointer_of(F.col("steps"))).drop("hidden", *(f"h{i}" for i in range(most)))


def synthesise(rows: DataFrame, seed: str, seconds: int, known_hosts: tuple[str, ...] = ()) -> DataFrame:
    """leaves with cls and ``out``, the value that takes its place; masked keys are handles in pointer and steps.

    Join keys' texts and masked keys take handles from one table, so that a name is one handle at keys and values of all
    files; uuids and whole numbers of join keys take stand-ins that the value decides. Null, empty and, but for join keys,
    0 stay; truth values are redrawn; other uuids are zeroed; numbers and texts keep their shape, in draws that the
    masked pointer decides. A container that was not opened is an error. The leaves are written once, with their classes.
    """
    kind, value = F.col("kind"), F.col("value")
    text_class = value_class(value, F.col("key"))
    number_class = F.when(join_class(F.col("key")).isNotNull(), "join int").otherwise("int")
    rows = rows.withColumn("cls", F.when(kind == "string", text_class).when(kind == "int", number_class).otherwise(kind))
    rows = cut(rows.withColumn("hides", F.exists("steps", lambda s: s["mask"].isNotNull())), "classes")
    joins = (F.col("cls") == "join") & ~value.rlike(UUID)
    wanted = rows.filter(joins).select("value", F.coalesce(join_class(F.col("key")), F.lit("id")).alias("cls"))
    keys = rows.filter("hides").select(F.explode(F.filter("steps", lambda s: s["mask"].isNotNull() & ~s["name"].rlike(UUID))).alias("s")).select(F.col("s.name").alias("value"), F.col("s.mask").alias("cls"))
    given = cut(handles(wanted.unionByName(keys), seed).select("value", "handle"), "handles")
    rows = rows.filter(~F.col("hides")).unionByName(_masked_steps(rows.filter("hides"), given, seed))
    given = given.withColumnRenamed("value", "named")
    joined = rows.filter(joins).join(given, F.col("value") == F.col("named"), "left").drop("named")
    rows = joined.unionByName(rows.filter(~F.coalesce(joins, F.lit(False))).withColumn("handle", F.lit(None).cast("string")))
    rows = rows.withColumn("digest", draw(seed, "leaf", F.col("file"), F.col("pointer")))
    d = F.col("digest")
    out = (
        F.when((kind == "nested") & ~value.isin("{}", "[]"), F.raise_error(F.concat(F.lit("not opened: "), "file")).cast("string"))
        .when(kind.isin("null", "nested") | F.col("cls").isin("empty", "enum", "extension"), value).when(F.col("cls") == "join", F.coalesce("handle", stand_in_uuid(value, seed))).when(kind == "bool", F.when(draw_int(d, 2) == 0, "false").otherwise("true"))
        .when(F.col("cls") == "join int", stand_in_number(value, seed))
        .when(kind == "int", F.coalesce(shift_epoch(value, seconds), F.when(is_coordinate(F.col("key"), F.col("parent_key")), F.lit("1")), redact_int(value, d)))
        .when(kind == "float", F.when(is_coordinate(F.col("key"), F.col("parent_key")), fake_coordinate(value, d)).otherwise(redact_float(value, d)))
        .when(F.col("cls") == "url", redact_url(value, known_hosts)).when(F.col("cls") == "latlon", redact_latlon(value, d)).when(F.col("cls") == "datetime", F.coalesce(shift_date(value, seconds), generic_tag(d)))
        .when(F.col("cls") == "uuid", F.lit(ZERO_UUID))
        .when(F.col("cls") == "filename", redact_filename(value, seconds)).when(F.col("cls") == "digits", F.coalesce(shift_epoch(value, seconds), redact_int(value, d))).otherwise(generic_tag(d))
    )
    return rows.withColumn("out", out).drop("digest", "handle", "hides")


# ---- rules and reports ----


def rule_hits(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves that a masking rule meets, and rules that meet none (an error for the caller).

    rules: rule, file_glob, pointer with ``*`` for any one step; they go to every task, so that more than MAX_RULES are
    refused.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    glob = lambda c: F.concat(F.lit("^"), F.replace(F.regexp_replace(c, r"([.+^$()\[\]{}|?\\])", r"\\$1"), F.lit("*"), F.lit("[^/]*")), F.lit(r"\z"))
    small = F.broadcast(rules.select("rule", glob(F.col("file_glob")).alias("fg"), glob(F.col("pointer")).alias("pg"), F.size(F.split("pointer", "/")).alias("steps")))
    met = rows.withColumn("steps", F.size(F.split("pointer", "/"))).join(small, "steps").filter(F.regexp_like("file", F.col("fg")) & F.regexp_like("pointer", F.col("pg"))).drop("fg", "pg", "steps")
    return met, rules.join(met.select("rule").distinct(), "rule", "left_anti")


def masked_pointer(c: Column) -> Column:
    """A pointer for reports: long runs and digits of its steps are blotted out."""
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z0-9]{16,}", "…"), "[0-9]+", "9")


def tallies(rows: DataFrame) -> DataFrame:
    """Leaves by file, kind and class."""
    return rows.groupBy("file", "kind", "cls").agg(F.count(F.lit(1)).alias("n"))


def key_tallies(rows: DataFrame) -> DataFrame:
    """file, masked and kept: different keys at different places that a rule masked, and known labels that one kept.

    rows: leaves, or what synthesise makes of them.
    """
    spelt = F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1))), lambda i: F.struct(pointer_of(F.slice("steps", 1, i)).alias("place"), F.get("steps", i - 1)["name"].alias("name"), F.get("steps", i - 1)["mask"].alias("mask")))
    each = rows.select("export_id", "file", F.explode(spelt).alias("k"))
    keys = each.filter("k.name is not null").select("export_id", "file", "k.*").distinct()
    label = F.array_join(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""), " ")
    return keys.groupBy("file").agg(F.count_if(F.col("mask").isNotNull()).alias("masked"), F.count_if(F.col("mask").isNull() & label.isin(*SCHEMA_LABELS)).alias("kept"))


def array_tallies(rows: DataFrame, n: int) -> DataFrame:
    """file, arrays, truncated and left_out: arrays with elements, those longer than n, and elements beyond n (n = 0 keeps all).

    rows: leaves. An array is known by its place in its document; its length is its last element's number and one.
    """
    places = F.filter(F.transform("steps", lambda s, i: F.struct(pointer_of(F.slice("steps", 1, i)).alias("place"), s["at"].alias("at"))), lambda p: p["at"].isNotNull())
    sizes = rows.select("export_id", "file", F.explode(places).alias("p")).groupBy("export_id", "file", "p.place").agg((F.max("p.at") + 1).cast("long").alias("size"))
    beyond = F.greatest(F.col("size") - n, F.lit(0)) if n else F.lit(0).cast("long")
    return sizes.groupBy("file").agg(F.count(F.lit(1)).alias("arrays"), F.count_if(beyond > 0).alias("truncated"), F.sum(beyond).alias("left_out"))


def vocabulary_used(rows: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """word and n: words of the vocabulary, in lower case, that values kept, and in how many values. rows: of synthesise."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    kept = F.array_intersect(words("value"), words("out"))
    each = rows.filter("kind = 'string'").select(F.explode(kept).alias("word")).filter(F.col("word").isin(*(w.lower() for w in vocabulary)))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def key_texts(rows: DataFrame) -> DataFrame:
    """file, pointer, kind and value of every key that no rule masked, once for each document, for leak_check. rows: with
    steps, as synthesise makes them."""
    spelt = F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1))), lambda i: F.struct(pointer_of(F.slice("steps", 1, i)).alias("pointer"), F.get("steps", i - 1)["name"].alias("value"), F.get("steps", i - 1)["mask"].alias("mask")))
    each = rows.select("file", F.explode(spelt).alias("k")).select("file", "k.*").filter("value is not null and mask is null")
    return each.select("file", "pointer", F.lit("key").alias("kind"), "value").distinct()


def generated_tokens(rows: DataFrame) -> DataFrame:
    """token: words and numbers of the stand-ins that synthesise made, of values and of masked keys, for leak_check."""
    made = rows.filter(~F.col("cls").isin("empty", "enum", "extension", "nested", "null")).select(F.col("out").alias("t"))
    keys = rows.select(F.explode(F.filter("steps", lambda s: s["mask"].isNotNull())).alias("s")).select(F.col("s.name").alias("t"))
    return made.unionByName(keys).select(F.explode(F.regexp_extract_all("t", F.lit("([A-Za-z]{6,}|[0-9]+)"), F.lit(1))).alias("token")).distinct()


def id_keyed_containers(keys: DataFrame, schema_words: tuple[str, ...] = (), least: int = 4) -> DataFrame:
    """Containers whose keys look like ids: least keys of one kind, half of the unknown ones in no other container.

    keys: container, key, kind of the value.
    """
    known = F.col("key").isin(*schema_words) if schema_words else F.lit(False)
    spread = keys.groupBy("key").agg(F.countDistinct("container").alias("homes"))
    g = keys.join(spread, "key").groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind").alias("kinds"), F.count_if(~known).alias("own"), F.count_if(~known & (F.col("homes") == 1)).alias("single"))
    return g.filter((F.col("n") >= least) & (F.col("kinds") == 1) & (F.col("own") > 0) & (2 * F.col("single") >= F.col("own")))


def vocabulary_gaps(paths: DataFrame, vocabulary: tuple[str, ...], longest: int = MAX_RUN) -> DataFrame:
    """bucket, word and n: parts of JSON files' names that a vocabulary of names does not hold.

    paths: path below the ``json`` folder. named: a word of a plain file name, which alone is shown; over_cap: such a
    word beyond longest characters; not_fixable: digits, dates, ids and other signs of a plain file name; withheld: a
    word of a path with folders, of which nothing is known. Every find is in one bucket.
    """
    known = [w.lower() for w in (*vocabulary, *EXTENSIONS)]
    nested = F.contains("path", F.lit("/"))
    token = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z][A-Za-z0-9]*|[0-9]+|[^A-Za-z0-9]+)"
    each = paths.select(nested.alias("nested"), F.explode(F.regexp_extract_all("path", F.lit(token), F.lit(1))).alias("t"))
    word = F.col("t").rlike(r"^[A-Za-z][A-Za-z0-9]*\z")
    plain = F.lower("t").isin(*known) | F.col("t").rlike(r"^[._~/-]+\z")
    bucket = F.when(plain, None).when(F.col("nested"), F.when(word, "withheld")).when(~word, "not_fixable").when(F.length("t") > longest, "over_cap").otherwise("named")
    found = each.withColumn("bucket", bucket).filter("bucket is not null").withColumn("word", F.when(F.col("bucket") == "named", F.lower("t")))
    return found.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n"))


# ---- leaks ----


def alnum_runs(rows: DataFrame, text_col: str, least: int = 20) -> DataFrame:
    """Each run of at least so many letters and digits, with the row's other columns."""
    return rows.withColumn("run", F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-z0-9]{{{least},}})"), F.lit(1)))).drop(text_col)


def live_url(url: Column, known_hosts: tuple[str, ...] = ()) -> Column:
    """True for a URL with any part (userinfo, host, port, path, parameter, fragment) that redact_url doesn't make."""
    hosts = "|".join(re.escape(h) for h in ("redacted.invalid", *known_hosts))
    chunk = f"(REDACTED|({'|'.join(KNOWN_PARAMS)}|REDACTED)=REDACTED)?"
    return ~url.rlike(rf"^[A-Za-z][A-Za-z0-9+.-]*://({hosts})(/(REDACTED)?)*(\?{chunk}(&{chunk})*)?(#(REDACTED)?)?\z")


def leak_check(out: DataFrame, generated: DataFrame, vocabulary: tuple[str, ...] = (), known_hosts: tuple[str, ...] = (), longest: int = 32) -> DataFrame:
    """file, pointer (masked), rule, n_chars and a masked excerpt of whatever in a redacted corpus was not generated, a
    row for each find.

    out: file, pointer, kind, value. generated: token. Rules: long_run (longest letters and digits or more), live_url (a
    part that is not a stand-in), coordinate (a pair, labelled or with decimals, of which one is outside 1 to 2), token
    (six letters or more that nothing generated and no vocabulary holds), number (digits that nothing generated; 0 is
    exempt).
    """
    every = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(0))
    found = lambda rule, texts: F.transform(texts, lambda t: F.struct(F.lit(rule).alias("rule"), F.length(t).cast("long").alias("n_chars"), masked_excerpt(t).alias("excerpt")))
    urls = F.transform(every(URL_IN_TEXT), lambda u: F.regexp_replace(u, r"[.,);]+\z", ""))
    inside = lambda t, i: F.coalesce(F.regexp_extract(t, PAIR_END, i).try_cast("double").between(1 - 1e-9, 2 + 1e-9), F.lit(False))
    finds = (
        found("long_run", every(f"[A-Za-z0-9]{{{longest},}}")), found("live_url", F.filter(urls, lambda u: live_url(u, known_hosts))),
        found("coordinate", F.filter(every(PAIR_IN_TEXT), lambda t: ~(inside(t, 1) & inside(t, 2)))),
    )
    direct = out.select("file", "pointer", F.explode(F.concat(*finds)).alias("s")).select("file", masked_pointer(F.col("pointer")).alias("pointer"), "s.*")
    strange = strange_tokens(out, generated, vocabulary)
    return direct.unionByName(strange.select("file", masked_pointer(F.col("pointer")).alias("pointer"), "rule", F.length("token").cast("long").alias("n_chars"), masked_excerpt(F.col("token")).alias("excerpt")))


def strange_tokens(out: DataFrame, generated: DataFrame, vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """file, pointer, token and rule (token or number) of what nothing generated and no vocabulary holds."""
    tokens = out.select("file", "pointer", F.explode(F.regexp_extract_all("value", F.lit("([A-Za-z]{6,}|[0-9]+)"), F.lit(1))).alias("token"))
    fine = F.lower("token").isin(*[w.lower() for w in (*vocabulary, *FILE_WORDS, *EXTENSIONS, *ENUM_WORDS, "redacted", "latitude", "longitude", "invalid")]) | F.col("token").rlike("^(x+|0+)$")
    strange = tokens.filter(~fine).join(generated.select("token").distinct(), "token", "left_anti")
    return strange.select("file", "pointer", "token", F.when(F.col("token").rlike("^[0-9]"), "number").otherwise("token").alias("rule"))


def mirrored_names(files: DataFrame, seconds: int = 0) -> DataFrame:
    """files (export_id, file) with ``mirror``: the masked name, ``stem-2.ext`` and so on where names of an export meet,
    in order of the files' own names. Masked names hold no digits but dates, so a number never meets another's stem."""
    name = redact_filename(F.col("file"), seconds)
    by = Window.partitionBy("export_id", "masked").orderBy("file")
    rows = files.select("export_id", "file").distinct().withColumn("masked", name).withColumn("k", F.row_number().over(by))
    stem, end = F.regexp_extract("masked", r"(?s)^(.*?)(\.[^./]*)?\z", 1), F.regexp_extract("masked", r"(?s)^(.*?)(\.[^./]*)?\z", 2)
    return rows.select("export_id", "file", F.when(F.col("k") == 1, F.col("masked")).otherwise(F.concat(stem, F.lit("-"), F.col("k").cast("string"), end)).alias("mirror"))


def masked_excerpt(c: Column, limit: int = 80) -> Column:
    """A text for reports: every run of word characters as stars, but for REDACTED, cut at limit characters."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W)"), F.lit(1))
    starred = F.array_join(F.transform(pieces, lambda t: F.when((t == "REDACTED") | ~t.rlike(r"(?U)^\w"), t).otherwise(F.repeat(F.lit("*"), F.length(t)))), "")
    return F.when(F.length(starred) <= limit, starred).otherwise(F.concat(F.left(starred, F.lit(limit)), F.lit("...")))


def write_redacted(rows: DataFrame, path: str, seconds: int = 0) -> None:
    """A mirror of a redacted corpus under path: ``documents`` (JSON texts nested again, in a folder for each export and
    mirrored name), ``listing`` (mirrored names with their numbers of leaves) and ``report`` (leaves by kind and class).

    rows: what synthesise gives. Original names appear in none of them.
    """
    names = mirrored_names(rows, seconds)
    docs = renest(rows).join(names, ["export_id", "file"]).select("export_id", F.col("mirror").alias("file"), "body")
    docs.write.partitionBy("export_id", "file").mode("overwrite").text(f"{path}/documents")
    counted = rows.groupBy("export_id", "file").agg(F.count(F.lit(1)).alias("leaves")).join(names, ["export_id", "file"])
    counted.select("export_id", F.col("mirror").alias("file"), "leaves").write.mode("overwrite").parquet(f"{path}/listing")
    named = rows.join(names, ["export_id", "file"]).drop("file").withColumnRenamed("mirror", "file")
    tallies(named).write.mode("overwrite").parquet(f"{path}/report")


def renest(rows: DataFrame, value: str = "out") -> DataFrame:
    """export_id, file and body: JSON built from leaves again, level by level from the deepest, as objects and arrays by
    the kind of each step. Keys of an object come in order."""
    key = ["export_id", "file"]
    literal = F.when(F.col("kind") == "string", F.to_json(F.array(F.col(value)))).otherwise(F.concat(F.lit("["), F.coalesce(F.col(value), F.lit("null")), F.lit("]")))
    body = F.substring(literal, F.lit(2), F.length(literal) - 2)
    path = F.transform("steps", lambda s: F.struct(s["name"].alias("name"), s["at"].alias("at")))
    each = cut(rows.select(*key, path.alias("path"), body.alias("body")), "texts")
    deepest = each.agg(F.max(F.size("path"))).first()[0] or 0
    label = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    level = each.filter(F.size("path") == deepest)
    for depth in range(deepest, 0, -1):
        here = level.select(*key, F.slice("path", 1, depth - 1).alias("path"), F.element_at("path", -1).alias("s"), "body")
        entry = F.struct(F.col("s.at").alias("at"), F.col("s.name").alias("name"), "body")
        grouped = here.groupBy(*key, "path").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.bool_and(F.col("s.name").isNull()).alias("list"))
        array = F.concat(F.lit("["), F.array_join(F.transform("e", lambda s: s["body"]), ","), F.lit("]"))
        object_ = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda s: F.concat(label(s["name"]), F.lit(":"), s["body"])), ","), F.lit("}"))
        level = each.filter(F.size("path") == depth - 1).unionByName(grouped.select(*key, "path", F.when(F.col("list"), array).otherwise(object_).alias("body")))
    return level.select(*key, "body")
