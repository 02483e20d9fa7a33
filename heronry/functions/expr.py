"""Scalar rules of personal-data archives as Spark columns: times, places, names, paths, text output.

Every function takes and returns columns and runs in the JVM. Unless stated otherwise a null gives a null.
An empty text means that a value is absent (see ``opt_text``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format, as the archives spell them.
MEDIA_WORDS = ("TEXT", "MEDIA", "STATUS", "NOTE", "STICKER", "IMAGE", "VIDEO")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
VIDEO_EXTENSIONS = ("mp4",)
CHAT_TOKENS = ("b", "media", "overlay", "thumbnail")
PART_PREFIX = "mydata~"
ITEM_KINDS = ("memory", "chat_media", "history_export")
ITEM_STATUSES = ("pending", "done", "failed", "source_missing", "retired", "excluded", "claimed")
#: Seconds from 1904 to 1970.
MAC_EPOCH = 2_082_844_800
RESERVED_STEMS = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
MAX_DIR_NAME = 64
UNNAMED_DIR = "_unnamed"
NO_CONVERSATION_DIR = "_no-conversation"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """ASCII letters in lower case; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def trim_unicode(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# ---- absence ----


def opt_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def opt_epoch(c: Column) -> Column:
    """An epoch of 0 is no epoch; negative ones are."""
    return F.nullif(c, F.lit(0).cast("long"))


# ---- times ----

_UTC = r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]) (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] UTC\z"
_PARTS = ("year", "month", "day", "hour", "minute", "second")


def parse_utc(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC`` as a struct of its six numbers; null if a number is out of its range.

    Days run to 31 in every month: February 30 is a value that can be ordered, not a moment. ``to_moment`` tells.
    """
    # what has the form has its numbers at fixed places
    number = [F.substring(c, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    return F.when(c.rlike(_UTC), F.struct(*(n.alias(p) for n, p in zip(number, _PARTS, strict=True))))


def to_moment(stamp: Column) -> Column:
    """The timestamp of a struct of six numbers; null if no calendar has it."""
    return F.try_make_timestamp(*(stamp[p] for p in _PARTS[:5]), stamp["second"].cast("decimal(16,6)"))


def stamp_text(stamp: Column) -> Column:
    return F.when(stamp.isNotNull(), F.format_string("%04d-%02d-%02d %02d:%02d:%02d UTC", *(stamp[p] for p in _PARTS)))


def epoch_stamp(ms: Column) -> Column:
    """Milliseconds as a struct of six numbers, floored to the second; null for years outside 0 to 65535."""
    seconds = F.floor(ms / F.lit(1000).cast("decimal(10,0)")).cast("long")
    t = F.when(seconds.between(-62167219200, 2005949145599), F.timestamp_seconds(seconds))
    return F.when(t.isNotNull(), F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second")))


def epoch_moment(ms: Column) -> Column:
    return F.date_trunc("second", F.timestamp_millis(ms))


def resolved_created(created: Column, ms: Column) -> Column:
    """The stated time, else the epoch's."""
    return F.coalesce(created, epoch_stamp(ms))


def day_of(c: Column) -> Column:
    """A ``YYYY-MM-DD`` text with month and day in their ranges, else null."""
    fits = c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z")
    return F.when(fits, c)


def neighbours(day: Column) -> Column:
    """The next and the previous day, in this order; null for a day that no calendar has."""
    d = F.try_to_date(day, "yyyy-MM-dd")
    return F.when(d.isNotNull(), F.array(F.date_format(F.date_add(d, 1), "yyyy-MM-dd"), F.date_format(F.date_add(d, -1), "yyyy-MM-dd")))


def to_local(moment: Column, zone: Column) -> Column:
    """A struct of wall time and offset in seconds at a moment in a zone; no zone: offset 0."""
    local = F.coalesce(F.from_utc_timestamp(moment, zone), moment)
    return F.struct(local.alias("local"), (F.unix_seconds(local) - F.unix_seconds(moment)).cast("int").alias("offset"))


def format_offset(seconds: Column) -> Column:
    minutes = F.floor(F.abs(seconds) / 60)
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60))


def parse_offset(c: Column) -> Column:
    """``±H:M`` as seconds; a day or more is no offset."""
    shape = r"^([+-])([+-]?[0-9]{1,9}):([+-]?[0-9]{1,9})\z"
    total = F.regexp_extract(c, shape, 2).try_cast("long") * 3600 + F.regexp_extract(c, shape, 3).try_cast("long") * 60
    signed = F.when(F.regexp_extract(c, shape, 1) == "-", -total).otherwise(total)
    return F.when(c.rlike(shape) & F.abs(signed).between(0, 86399), signed.cast("int"))


def mac_epoch_moment(raw: Column) -> Column:
    """Seconds since 1904 as a timestamp; null before the second of 1970."""
    unix = raw - F.lit(MAC_EPOCH)
    return F.when(unix >= 1, F.timestamp_seconds(unix))


def moment_mac_epoch(moment: Column) -> Column:
    unix = F.unix_seconds(moment)
    return F.when(unix >= 1, unix + F.lit(MAC_EPOCH))


def age_text(stamp: Column, now: Column) -> Column:
    """How long ago, in the largest unit that fits; the date from 30 days on and for the future."""
    moment = to_moment(stamp)
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(moment)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    date = F.format_string("%04d-%02d-%02d", stamp["year"], stamp["month"], stamp["day"])
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(stamp.isNull(), None)
        .when(moment.isNull() | (moment > now) | (days >= 30), date)
        .when(minutes == 0, "now")
        .when(minutes < 60, text(minutes, "m"))
        .when(hours < 24, text(hours, "h"))
        .when(days < 7, text(days, "d"))
        .otherwise(text(F.floor(days / 7), "w"))
    )


# ---- places ----

_POINT = "latitude, longitude:"
_NUMBER = r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
#: Two numbers with a comma and white space of any script between and around them.
_PAIR = rf"(?U)^\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\z"


def location_numbers(c: Column) -> tuple[Column, Column]:
    """The two numbers behind a label's place in a text, whatever the label and the numbers are; null if there are no such two."""
    pair = F.substring(c, len(_POINT) + 1, 1 << 30)
    lat, lon = (F.regexp_extract(pair, _PAIR, i).try_cast("double") for i in (1, 2))
    return lat, lon


def split_location(c: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
    """A struct of point (lat, lon), place and bad: a labelled pair of degrees, or any other name.

    bad is true for the label with anything but two finite numbers in range behind it. Empty is absent. lat, lon: what
    location_numbers has, for callers that bind it, as each is looked at many times.
    """
    if lat is None or lon is None:
        lat, lon = location_numbers(c)
    text = opt_text(c)
    labelled = fold(F.left(text, F.lit(len(_POINT)))) == _POINT
    good = F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))
    return F.struct(
        F.when(labelled & good, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("point"),
        F.when(~labelled, text).alias("place"),
        F.coalesce(labelled & ~good, F.lit(False)).alias("bad"),
    )


def iso6709(lat: Column, lon: Column) -> Column:
    return F.format_string("%+010.6f%+011.6f/", lat, lon)


def dms(degrees: Column) -> Column:
    """Degrees, minutes, and ten-thousandths of seconds of an absolute angle."""
    a = F.abs(degrees)
    minutes = (a - F.floor(a)) * 60
    return F.struct(F.floor(a).cast("int").alias("degrees"), F.floor(minutes).cast("int").alias("minutes"), F.round((minutes - F.floor(minutes)) * 60 * 10000).cast("int").alias("seconds_e4"))


def hemisphere(degrees: Column, positive: str, negative: str) -> Column:
    return F.when(degrees < 0, negative).otherwise(positive)


# ---- words and errors ----


def media_kind(c: Column) -> Column:
    """A known media word in capitals, whatever its case; any other text as it is."""
    return F.when(F.translate(c, _LOWER, _UPPER).isin(*MEDIA_WORDS), F.translate(c, _LOWER, _UPPER)).otherwise(c)


def kind_of_ext(c: Column) -> Column:
    e = fold(c)
    return F.when(e.isin(*VIDEO_EXTENSIONS), "video").when(e.isin(*IMAGE_EXTENSIONS), "image").otherwise("unknown")


def kind_of_word(c: Column) -> Column:
    """What a media word says an entry is; only image and video do."""
    w = F.translate(c, _LOWER, _UPPER)
    return F.when(w == "IMAGE", "image").when(w == "VIDEO", "video").otherwise("unknown")


def validation_error(file: str, field: str, expected: str, c: Column, valid: Column) -> Column:
    """A struct that names file, field, expectation and length of a present value that is not valid, never the value."""
    wrong = opt_text(c).isNotNull() & ~F.coalesce(valid, F.lit(False))
    return F.when(wrong, F.struct(F.lit(file).alias("file"), F.lit(field).alias("field"), F.lit(expected).alias("kind"), F.char_length(c).alias("n_chars")))


def strip_delimited(c: Column) -> Column:
    """An error text with an ellipsis for what stands in double quotes (which backslashes escape) or backticks.

    A run that is not closed takes the rest of the text with it.
    """
    quoted = F.regexp_replace(c, r'(?s)"(?:\\.?|[^"\\])*+("|\z)', '"…$1')
    return F.regexp_replace(quoted, r"(?s)`[^`]*+(`|\z)", "`…$1")


def wrapped_json(body: Column) -> Column:
    """A JSON text as the element of a list, a variant; only_element takes it out."""
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))


def only_element(wrapped: Column) -> Column:
    """The element of a list; null if it holds more. ``wrapped`` is looked at twice and should be bound."""
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_strict(body: Column) -> Column:
    """A JSON text as a variant; null if it is no JSON, holds a key twice, or goes on behind its end."""
    return only_element(wrapped_json(body))


def unknown_words(kind: Column, status: Column) -> Column:
    """Names of the columns of a status row whose word is not known."""
    return F.filter(F.array(F.when(~kind.isin(*ITEM_KINDS), F.lit("kind")), F.when(~status.isin(*ITEM_STATUSES), F.lit("status"))), lambda x: x.isNotNull())


def valid_export_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]+\z")


def redact_note(note: Column, url: Column) -> Column:
    """A note whose telling tokens are blotted out; white space stays.

    A token goes if it has over 64 bytes, one of ``/ = % & @``, or a run of 12 letters and digits of the row's URL.
    """
    fragments = F.coalesce(F.regexp_extract_all(url, F.lit(r"([A-Za-z0-9]{12,})"), F.lit(1)), F.array().cast("array<string>"))
    pieces = F.regexp_extract_all(note, F.lit(r"(?U)(\S+|\s)"), F.lit(1))
    telling = lambda t: (F.octet_length(t) > 64) | t.rlike("[/=%&@]") | F.exists(fragments, lambda f: F.contains(t, f))
    return F.array_join(F.transform(pieces, lambda t: F.when(telling(t), F.lit("<redacted>")).otherwise(t)), "")


# ---- file names ----


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


_MEMORY = r"^([0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))_([A-Za-z0-9]{8}(?:-[A-Za-z0-9]{4}){3}-[A-Za-z0-9]{12})-(main|overlay)\.([^.]*)\z"
_CHAT = r"(?s)^([0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))_([A-Za-z]+)~(.*)\.([^.]*)\z"
_PLAIN = r"^[A-Za-z0-9]+\z"
_ZIPPED = r"^([A-Za-z0-9]+-[0-9]+)\.zip\.([A-Za-z0-9]+)\z"


def _groups(c: Column, pattern: str, names: tuple[str, ...]) -> Column:
    return F.when(c.rlike(pattern), F.struct(*(F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(names))))


def parse_memory_name(path: Column) -> Column:
    """``DAY_uuid-role.ext`` as a struct of day, uuid, role and extension, else null."""
    return _groups(base_name(path), _MEMORY, ("day", "uuid", "role", "extension"))


def parse_chat_name(path: Column) -> Column:
    """``DAY_token~id.ext`` or ``DAY_token~word-digits.zip.hash.ext`` as a struct, else null.

    family is plain or zip. id is token and id without the day for plain names, so that a history's token meets it
    on any day; for zip names it keeps day, middle and hash, but not the token: both roles of a pair share it.
    """
    name = base_name(path)
    part = lambda i: F.regexp_extract(name, _CHAT, i)
    token, tail = fold(part(2)), part(3)
    plain, zipped = tail.rlike(_PLAIN), tail.rlike(_ZIPPED)
    key = F.when(plain, F.concat(token, F.lit("~"), tail)).otherwise(F.concat(part(1), F.lit("_"), tail))
    good = name.rlike(_CHAT) & token.isin(*CHAT_TOKENS) & (plain | zipped)
    return F.when(good, F.struct(part(1).alias("day"), token.alias("token"), F.when(plain, "plain").otherwise("zip").alias("family"), key.alias("id"), part(4).alias("extension")))


def media_tokens(c: Column) -> Column:
    """Parts between vertical bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\|"), trim_unicode), lambda t: t != "")


def history_token(c: Column) -> Column:
    """``b~`` and letters or digits, the prefix in lower case, else null."""
    t = trim_unicode(c)
    return F.when(t.rlike(r"^[bB]~[A-Za-z0-9]+\z"), F.concat(F.lit("b~"), F.substring(t, 3, 1 << 30)))


def parse_part(stem: Column) -> Column:
    """``mydata~id`` or ``mydata~id-n`` as a struct of id and number; n counts from 2 and has no leading zero."""
    rest = F.when(F.startswith(stem, F.lit(PART_PREFIX)), F.substring(stem, len(PART_PREFIX) + 1, 1 << 30))
    tail = r"(?s)^(.*)-([1-9][0-9]*)\z"
    number = F.regexp_extract(rest, tail, 2).try_cast("long")
    numbered = F.coalesce(rest.rlike(tail) & number.between(2, 4294967295), F.lit(False))
    name = F.when(numbered, F.regexp_extract(rest, tail, 1)).otherwise(rest)
    return F.when(name != "", F.struct(name.alias("id"), F.when(numbered, number).otherwise(1).alias("number")))


def leg_of(ext: Column) -> Column:
    """image, video, or null for a format that is not handled."""
    return F.nullif(kind_of_ext(ext), F.lit("unknown"))


def output_ext(ext: Column) -> Column:
    e = fold(ext)
    return F.when(e == "png", "png").when(e.isin(*IMAGE_EXTENSIONS), "jpg").when(e.isin(*VIDEO_EXTENSIONS), "mp4")


def output_stem(local: Column) -> Column:
    return F.date_format(local, "yyyyMMdd_HHmmss")


def output_dir(root: Column, local: Column) -> Column:
    return F.concat(root, F.lit("/"), F.date_format(local, "yyyy/MM"))


def output_name(stem: Column, ext: Column, ordinal: Column) -> Column:
    """``stem.ext`` for ordinal 0, ``stem_2.ext`` for 1 and so on."""
    return F.concat(stem, F.when(ordinal == 0, "").otherwise(F.concat(F.lit("_"), (ordinal + 1).cast("string"))), F.lit("."), ext)


def dir_name(key: Column) -> Column:
    """A portable directory name: other characters become ``_``, 64 at most, no dots at the ends, no device names."""
    cut = F.regexp_replace(F.left(F.regexp_replace(key, r"(?s)[^A-Za-z0-9._-]", "_"), F.lit(MAX_DIR_NAME)), r"^\.+|\.+\z", "")
    stem = fold(F.substring_index(cut, ".", 1))
    return F.when(cut == "", UNNAMED_DIR).when(stem.isin(*RESERVED_STEMS), F.concat(F.lit("_"), cut)).otherwise(cut)


def is_unsafe_path(c: Column) -> Column:
    """A path in an archive that would leave its folder: rooted, with a drive letter, climbing out, or empty."""
    parts = F.split(c, r"[/\\]")
    depth = F.aggregate(
        F.split(c, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, s: F.struct((d := F.when(s == "..", a["d"] - 1).when(s.isin("", "."), a["d"]).otherwise(a["d"] + 1)).alias("d"), F.least(a["low"], d).alias("low")),
        lambda a: a["low"],
    )
    return c.rlike(r"^[/\\]") | F.exists(parts, lambda s: s.rlike("^[A-Za-z]:")) | (depth < 0) | (c == "") | F.contains(c, F.lit("\0"))


def normalize_path(c: Column) -> Column:
    """A path without empty, ``.`` and inner ``..`` parts; file systems are not asked."""
    rooted = F.startswith(c, F.lit("/"))
    parts = F.aggregate(
        F.filter(F.split(c, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"),
        lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((s == "..") & rooted, a).otherwise(F.concat(a, F.array(s))),
    )
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


# ---- text output ----


def csv_field(c: Column) -> Column:
    """A field that spreadsheets take for text (a quote before ``= + - @``, tab and CR), quoted where it must be."""
    text = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def bound_bytes(c: Column, n: int = 256) -> Column:
    """The longest start of a text that has at most n bytes and ends between characters."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.octet_length(F.left(c, i)) <= n)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.left(c, F.array_max(fits)))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def binary_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit that reads below 1024."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    for i, unit in enumerate(units):
        value = n.cast("double") / F.lit(float(1024 ** (i + 1)))
        text = F.format_string(f"%.1f {unit}", value)
        out = out.when(value < 1023.95, text) if i < len(units) - 1 else out.otherwise(text)
    return out
