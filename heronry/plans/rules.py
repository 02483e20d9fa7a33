"""Queries of scalar rules, planning and the status table over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators import plan, reconcile, status, timeline
from heronry.plans import views
from heronry.plans.registry import NOW, query
from heronry.plans.views import sql
from heronry.sources.tables import table


def _pick(n: Column, *values: Column | str | None) -> Column:
    """The value at place n, which counts from 0."""
    out = F.when(n == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n == i, v)
    return out


# ---- words, places, times ----


@query(
    """SELECT c_custkey, CASE WHEN k = 0 AND ok THEN n * 10.0 WHEN k = 1 THEN 12.5 END AS lat, CASE WHEN k = 0 AND ok THEN -(c_custkey % 200)::DOUBLE WHEN k = 1 THEN -3.0 END AS lon,
  CASE WHEN k = 2 THEN c_name END AS place, k = 4 OR (k = 0 AND NOT ok) AS bad
FROM (SELECT c_custkey, c_name, c_custkey % 5 AS k, c_nationkey AS n, c_nationkey * 10 <= 90 AND c_custkey % 200 <= 180 AS ok FROM customer)"""
)
def split_location(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    text = lambda v: v.cast("string")
    labelled = F.concat(F.lit("Latitude, Longitude: "), text(F.col("c_nationkey") * 10), F.lit(", -"), text(F.col("c_custkey") % 200))
    given = _pick(F.col("c_custkey") % 5, labelled, F.lit("latitude, longitude:12.5,-3"), F.col("c_name"), F.lit(""), F.concat(F.lit("LATITUDE, LONGITUDE: "), "c_name", F.lit(", 1")))
    where = x.split_location(given)
    return c.select("c_custkey", where["point"]["lat"].alias("lat"), where["point"]["lon"].alias("lon"), where["place"].alias("place"), where["bad"].alias("bad"))


_WORD = "CASE o_orderkey % 5 WHEN 0 THEN 'Image' WHEN 1 THEN 'vIdEo' WHEN 2 THEN 'text' WHEN 3 THEN '' ELSE o_orderpriority END"


@query(
    f"""SELECT o_orderkey, CASE WHEN upper(w) IN ('TEXT', 'MEDIA', 'STATUS', 'NOTE', 'STICKER', 'IMAGE', 'VIDEO') THEN upper(w) ELSE w END AS word,
  CASE upper(w) WHEN 'IMAGE' THEN 'image' WHEN 'VIDEO' THEN 'video' ELSE 'unknown' END AS kind, nullif(w, '') AS text, nullif(o_orderkey % 4, 0) AS epoch FROM (SELECT *, {_WORD} AS w FROM orders)"""
)
def media_words(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("w", _pick(F.col("o_orderkey") % 5, F.lit("Image"), F.lit("vIdEo"), F.lit("text"), F.lit(""), F.col("o_orderpriority")))
    return o.select("o_orderkey", x.media_kind(F.col("w")).alias("word"), x.kind_of_word(F.col("w")).alias("kind"), x.opt_text(F.col("w")).alias("text"), x.opt_epoch(F.col("o_orderkey") % 4).alias("epoch"))


@query("SELECT page_id, 'pages.json' AS file, 'url' AS field, 'timestamp' AS kind, len(url) AS n_chars FROM pages WHERE page_id % 3 > 0")
def validation_errors(s: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, "2021-02-30 00:00:00 UTC").otherwise("")).otherwise(F.col("url"))
    error = x.validation_error("pages.json", "url", "timestamp", stamp, x.parse_utc(stamp).isNotNull())
    out = table(s, d, "pages").select("page_id", error.alias("e")).filter("e is not null").select("page_id", "e.*")
    return out.withColumn("n_chars", F.col("n_chars").cast("long"))


@query("SELECT p_partkey, 'bad \"…\" of ' || p_type || ' near `…` at \"…' AS message FROM part")
def stripped_messages(s: SparkSession, d: str) -> DataFrame:
    given = F.concat(F.lit('bad "'), "p_name", F.lit(' \\" quoted" of '), "p_type", F.lit(" near `"), "p_brand", F.lit('` at "'), "p_name", F.lit(" `open"))
    return table(s, d, "part").select("p_partkey", x.strip_delimited(given).alias("message"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN k < 3 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day, CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'media' WHEN 2 THEN 'overlay' END AS token,
  CASE WHEN k = 0 THEN 'plain' WHEN k < 3 THEN 'zip' END AS family, CASE WHEN k = 0 THEN 'b~' || l_partkey WHEN k < 3 THEN strftime(l_shipdate, '%Y-%m-%d') || '_zip-' || l_orderkey || '.zip.a' || l_partkey END AS id,
  CASE WHEN k < 3 THEN 'PNG' END AS extension FROM (SELECT *, l_linenumber % 5 AS k FROM lineitem)"""
)
def chat_names(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    day, key = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_partkey").cast("string")
    zipped = lambda role: F.concat(F.lit("in/chat_media/"), day, F.lit(f"_{role}~zip-"), F.col("l_orderkey").cast("string"), F.lit(".zip.a"), key, F.lit(".PNG"))
    plain = F.concat(F.lit("in/"), day, F.lit("_B~"), key, F.lit(".PNG"))
    name = _pick(F.col("l_linenumber") % 5, plain, zipped("media"), zipped("Overlay"), F.concat(day, F.lit("_metadata~"), key, F.lit(".PNG")), F.concat(day, F.lit("_b~"), key))
    p = x.parse_chat_name(name)
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", *(p[c].alias(c) for c in ("day", "token", "family", "id", "extension")))


@query(
    """WITH f AS (SELECT (l_suppkey % 4)::VARCHAR AS export_id, strftime(l_shipdate, '%Y-%m') || '_zip-' || (l_orderkey % 50) AS id, l_linenumber % 2 = 0 AS main, 'p/' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS path FROM lineitem),
m AS (SELECT export_id, id, min(path) AS main_path FROM f WHERE main GROUP BY ALL), o AS (SELECT export_id, id, min(path) AS overlay_path FROM f WHERE NOT main GROUP BY ALL)
SELECT export_id, id, 'paired' AS side, main_path, overlay_path FROM m LEFT JOIN o USING (export_id, id) UNION ALL SELECT export_id, id, 'orphan', NULL, overlay_path FROM o ANTI JOIN m USING (export_id, id)"""
)
def pair_chat(s: SparkSession, d: str) -> DataFrame:
    """Units of a chat: paired files and overlays without a main file, in one table."""
    li = table(s, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    files = li.select(
        (F.col("l_suppkey") % 4).cast("string").alias("export_id"), F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("_zip-"), (F.col("l_orderkey") % 50).cast("string")).alias("id"),
        F.when(F.col("l_linenumber") % 2 == 0, "media").otherwise("overlay").alias("token"), F.lit("zip").alias("family"), F.concat(F.lit("p/"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_suppkey"))).alias("path"),
    )
    paired, orphans = reconcile.pair_chat(files)
    one = paired.select("export_id", "id", F.lit("paired").alias("side"), "main_path", "overlay_path")
    return one.unionByName(orphans.select("export_id", "id", F.lit("orphan").alias("side"), F.lit(None).cast("string").alias("main_path"), F.col("path").alias("overlay_path")))


@query(
    """SELECT o_orderkey, CASE WHEN s < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(s) // 3600, abs(s) // 60 % 60) AS offset_text, s AS parsed,
  CASE WHEN o_orderkey % 9 > 0 THEN epoch_us(o_orderdate) // 1000000 + 2082844800 END AS mac, CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS back,
  strftime(o_orderdate + INTERVAL (CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 120 ELSE -210 END) MINUTE, '%Y-%m-%d %H:%M') AS wall, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200 ELSE -12600 END AS zone_offset
FROM (SELECT *, ((o_orderkey % 53 - 26) * 1800)::INT AS s FROM orders)"""
)
def offsets_and_epochs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    key = F.col("o_orderkey")
    offset = (key % 53 - 26) * 1800
    moment = F.when(key % 9 > 0, F.col("o_orderdate").cast("timestamp"))
    mac = x.moment_mac_epoch(moment)
    wall = x.to_local(F.col("o_orderdate").cast("timestamp"), _pick(key % 3, None, F.lit("+02:00"), F.lit("-03:30")))
    return o.select(
        "o_orderkey", x.format_offset(offset).alias("offset_text"), x.parse_offset(x.format_offset(offset)).alias("parsed"), mac.alias("mac"), F.date_format(x.mac_epoch_moment(mac), "yyyy-MM-dd").alias("back"),
        F.date_format(wall["local"], "yyyy-MM-dd HH:mm").alias("wall"), wall["offset"].alias("zone_offset"),
    )


@query(
    """SELECT event_id, floor(a)::INT AS degrees, floor((a - floor(a)) * 60)::INT AS minutes, round(((a - floor(a)) * 60 - floor((a - floor(a)) * 60)) * 60 * 10000)::INT AS seconds_e4,
  CASE WHEN value < 100 THEN 'S' ELSE 'N' END AS half FROM (SELECT *, abs(value - 100) AS a FROM events)"""
)
def degrees_and_halves(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 100
    return table(s, d, "events").select("event_id", x.dms(v).alias("p"), x.hemisphere(v, "N", "S").alias("half")).select("event_id", "p.*", "half")


@query("SELECT doc_id, left(text, list_max(list_filter(range(0, 257), lambda i: strlen(left(text, i)) <= 256))) AS cut FROM documents")
def bounded_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", x.bound_bytes(F.col("text")).alias("cut"))


@query(
    """SELECT page_id, array_to_string(list_transform(regexp_extract_all(note, '\\S+|\\s'), lambda t: CASE WHEN strlen(t) > 64 OR regexp_matches(t, '[/=%&@]') OR len(list_filter(parts, lambda f: contains(t, f))) > 0 THEN '<redacted>' ELSE t END), '') AS note
FROM (SELECT page_id, 'could not read ' || url || ' part x' || md5(page_id::VARCHAR) || 'y or ' || md5('no') AS note, [md5(page_id::VARCHAR)] AS parts FROM pages)"""
)
def redact_note_with_url(s: SparkSession, d: str) -> DataFrame:
    """Notes that repeat a run of their item's URL."""
    secret = F.md5(F.col("page_id").cast("string"))
    note = F.concat(F.lit("could not read "), "url", F.lit(" part x"), secret, F.lit("y or "), F.md5(F.lit("no")))
    return table(s, d, "pages").select("page_id", x.redact_note(note, F.concat(F.lit("https://h/"), secret)).alias("note"))


@query(
    """SELECT o_orderkey, format('{:,}', (o_totalprice * 100)::BIGINT) AS amount, CASE WHEN m < 0 OR m >= 43200 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN m = 0 THEN 'now' WHEN m < 60 THEN m || 'm ago'
  WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 10080 THEN m // 1440 || 'd ago' ELSE m // 10080 || 'w ago' END AS age FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN -5 ELSE o_orderkey * o_orderkey % 50000 END AS m FROM orders)"""
)
def ages_and_amounts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    key = F.col("o_orderkey")
    minutes = F.when(key % 11 == 0, -5).otherwise(key * key % 50000)
    moment = F.col("o_orderdate").cast("timestamp")
    stamp = F.struct(*(getattr(F, p)(moment).alias(p) for p in ("year", "month", "day", "hour", "minute", "second")))
    now = F.timestamp_seconds(F.unix_seconds(moment) + minutes * 60)
    return o.select("o_orderkey", x.grouped(F.round(F.col("o_totalprice") * 100).cast("long")).alias("amount"), x.age_text(stamp, now).alias("age"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'kind' WHEN 2 THEN 'status' WHEN 3 THEN 'kind,status' ELSE '' END AS unknown, o_orderkey % 6 < 2 AS valid FROM orders")
def vocabulary(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    unknown = x.unknown_words(F.when(k % 2 == 1, "movie").otherwise("memory"), F.when(k % 4 >= 2, "lost").otherwise("done"))
    export = _pick(k % 6, F.concat(F.lit("a-"), k.cast("string")), F.concat(F.lit("A_"), k.cast("string")), F.lit(""), F.lit("é"), F.concat(k.cast("string"), F.lit("/")), F.concat(F.lit("a b"), k.cast("string")))
    return table(s, d, "orders").select("o_orderkey", F.array_join(unknown, ",").alias("unknown"), x.valid_export_id(export).alias("valid"))


@query(
    """SELECT page_id, k IN (0, 1, 2, 4, 6) AS unsafe, CASE k WHEN 0 THEN '/' || page_id WHEN 1 THEN 'C:/' || page_id WHEN 2 THEN '../' || page_id WHEN 3 THEN page_id::VARCHAR WHEN 4 THEN '' WHEN 5 THEN 'a/' || page_id ELSE 'x/D:/' || page_id END AS path
FROM (SELECT page_id, page_id % 7 AS k FROM pages)"""
)
def archive_paths(s: SparkSession, d: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    to = lambda before: F.concat(F.lit(before), key)
    path = _pick(F.col("page_id") % 7, to("/../"), to("C:/"), to("a/../../"), to("a/.././"), F.lit(""), to("a//./b/../"), to("x/D:/"))
    return table(s, d, "pages").select("page_id", x.is_unsafe_path(path).alias("unsafe"), x.normalize_path(path).alias("path"))


# ---- planning ----

_CAPTURE = "o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"


@query(
    f"""SELECT o_orderkey, CASE WHEN {_CAPTURE} THEN strftime(o_orderdate + INTERVAL 2 HOUR, '%Y%m%d_%H') WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 7 HOUR, '%Y%m%d_%H') WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y%m%d_%H') END AS local,
  CASE WHEN {_CAPTURE} THEN 7200 WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 > 0 THEN 0 END AS offset_s, CASE WHEN {_CAPTURE} THEN 'entry' WHEN o_orderkey % 5 = 0 THEN 'embedded' WHEN o_orderkey % 7 > 0 THEN 'filename' END AS source FROM orders"""
)
def captures(s: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(s, d, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, "exact").otherwise("ambiguous").alias("confidence"), F.when(k % 3 == 0, at).alias("entry_moment"), F.lit("+02:00").alias("zone"),
        F.when(k % 5 == 0, F.timestamp_seconds(F.unix_seconds(at) + 7 * 3600)).alias("embedded_local"), F.lit(None).cast("int").alias("embedded_offset"), F.when(k % 7 > 0, F.date_format(at, "yyyy-MM-dd")).otherwise("2021-02-30").alias("day"),
    )
    out = plan.capture(rows)
    return out.select("o_orderkey", F.date_format("capture.local", "yyyyMMdd_HH").alias("local"), F.col("capture.offset").alias("offset_s"), F.col("capture.source").alias("source"))


_DATED = "CASE WHEN k % 3 = 0 THEN 'created' WHEN k % 5 = 0 THEN 'epoch' WHEN k % 2 = 0 THEN 'filename' END"


@query(
    f"""SELECT k, source, CASE WHEN k % 4 = 3 THEN 'excluded' WHEN k % 13 = 0 OR source IS NULL THEN 'deferred' ELSE 'planned' END AS disposition,
  CASE WHEN k % 4 = 3 THEN 'thumbnail' WHEN k % 13 = 0 THEN 'unknown_format' WHEN source IS NULL THEN 'no_date' END AS why, k % 2 = 1 AS merged, k % 2 = 1 AND k % 3 <> 0 AS originals
FROM (SELECT o_orderkey AS k, {_DATED.replace("k ", "o_orderkey ")} AS source FROM orders)"""
)
def dispositions(s: SparkSession, d: str) -> DataFrame:
    """What becomes of chat media: the date that counts, whether it is planned, and what its overlay asks for."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    date = plan.media_date(F.when(k % 3 == 0, at), F.when(k % 5 == 0, F.unix_millis(at)), F.lit(None).cast("timestamp"), F.when(k % 2 == 0, F.date_format(at, "yyyy-MM-dd")))
    what = plan.disposition(F.when(k % 4 == 3, "thumbnail").otherwise("b"), x.leg_of(F.when(k % 13 == 0, "gif").otherwise("JPG")), date["moment"])
    merged, _ = plan.overlay_flags("merged", k % 2 == 1)
    _, both = plan.overlay_flags("both", k % 2 == 1)
    return table(s, d, "orders").select(k.alias("k"), date["source"].alias("source"), what["disposition"].alias("disposition"), what["why"].alias("why"), merged.alias("merged"), (both & (k % 3 != 0)).alias("originals"))


_COPIES = """c AS (SELECT (l_suppkey % 4)::VARCHAR AS export_id, l_orderkey AS seq, l_linenumber AS part, l_suppkey, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'IMG' WHEN 1 THEN 'img' ELSE 'p' || l_partkey END AS stem, CASE WHEN l_linenumber % 2 = 0 THEN 'JPG' ELSE 'jpg' END AS ext,
  row_number() OVER (PARTITION BY l_suppkey % 4, lower(CASE l_partkey % 3 WHEN 0 THEN 'IMG' WHEN 1 THEN 'img' ELSE 'p' || l_partkey END) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS i FROM lineitem)"""


@query(f"WITH {_COPIES} SELECT export_id, seq, part, l_suppkey, l_partkey, stem || CASE WHEN i > 1 THEN '_' || i ELSE '' END || '.' || ext AS copy FROM c")
def allocate_copies(s: SparkSession, d: str) -> DataFrame:
    """Two thirds of all rows ask for one name in two spellings."""
    k = F.col("l_partkey")
    rows = table(s, d, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("string").alias("export_id"), F.lit("/o").alias("dir"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"), F.col("l_linenumber").alias("part"),
        _pick(k % 3, F.lit("IMG"), F.lit("img"), F.concat(F.lit("p"), k.cast("string"))).alias("stem"), F.when(F.col("l_linenumber") % 2 == 0, "JPG").otherwise("jpg").alias("ext"),
    )
    return plan.allocate_copies(rows).select("export_id", F.col("seq.l_orderkey").alias("seq"), "part", "seq.l_suppkey", "seq.l_partkey", "copy")


@query("SELECT DISTINCT conv_id, f AS format, 'd' || conv_id || '/history.' || CASE f WHEN 'text' THEN 'txt' ELSE f END AS document_path FROM conversations, (SELECT unnest(['json', 'csv', 'text', 'html']) AS f)")
def document_names(s: SparkSession, d: str) -> DataFrame:
    dirs = table(s, d, "conversations").select("conv_id").distinct().withColumn("dir", F.concat(F.lit("d"), F.col("conv_id").cast("string")))
    return plan.document_names(dirs, timeline.FORMATS).select("conv_id", "format", "document_path")


@query(
    """SELECT DISTINCT (o_custkey % 16)::VARCHAR AS export_id, (o_custkey % 40)::VARCHAR AS conversation, 'd' || (o_custkey % 40 // 2) AS dir FROM orders WHERE o_orderkey % 3 = 0
UNION SELECT DISTINCT (o_custkey % 16)::VARCHAR, (o_custkey % 7)::VARCHAR, strftime(o_orderdate, '%Y') FROM orders WHERE o_orderkey % 3 = 1"""
)
def recorded_dirs(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    export = (F.col("o_custkey") % 16).cast("string").alias("export_id")
    conversation = (F.col("o_custkey") % 40).cast("string")
    items = o.select(
        export, F.when(k % 3 == 0, "history_export").otherwise("chat_media").alias("kind"), F.when(k % 3 == 0, conversation).otherwise(key).alias("source_id"), F.when(k % 3 == 0, "claimed").otherwise("done").alias("status"),
        _pick(k % 3, F.concat(F.lit("/out/d"), F.floor(F.col("o_custkey") % 40 / 2).cast("string")), F.concat(F.lit("/out/"), F.date_format("o_orderdate", "yyyy"), F.lit("/f.jpg")), None).alias("output_path"),
    )
    attribution = o.select(export, key.alias("token"), (F.col("o_custkey") % 7).cast("string").alias("conversation"))
    return plan.recorded_dirs(items, attribution)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 = 0")
def select_conversations(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").withColumn("export_id", F.lit("e")).withColumn("conversation", F.col("conv_id").cast("string"))
    return plan.select_conversations(c, c.filter("conv_id % 3 = 0").select("export_id", "conversation")).select("conv_id", "turn")


@query(
    """WITH t AS (SELECT (o_custkey % 4)::VARCHAR AS export_id, o_custkey::VARCHAR AS conversation, o_orderkey AS seq, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT export_id, conversation, seq, string_agg(CASE WHEN l_partkey % 50 <> 0 AND p_size % 3 = 0 THEN p_name || '-' || p_partkey || '.jpg' ELSE '-' END, '|' ORDER BY i) AS links FROM t LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
)
def resolve_links(s: SparkSession, d: str) -> DataFrame:
    messages = views.token_messages(s, d).withColumnRenamed("pos", "seq")
    p = table(s, d, "part")
    export = F.explode(F.array(*(F.lit(str(i)) for i in range(4)))).alias("export_id")
    key = F.col("p_partkey").cast("string")
    items = p.select(export, F.lit("chat_media").alias("kind"), F.concat(F.lit("b~"), key).alias("source_id"), F.when(F.col("p_size") % 3 == 0, "done").otherwise("failed").alias("status"), F.concat(F.lit("/o/"), "p_name", F.lit("-"), key, F.lit(".jpg")).alias("output_path"))
    out = timeline.resolve_links(messages, items)
    return out.select("export_id", "conversation", "seq", F.array_join(F.transform("links", lambda f: F.coalesce(f, F.lit("-"))), "|").alias("links"))


# ---- the status table ----


@query(sql("SELECT export_id, source_id FROM items WHERE k % 11 <> 0 AND status <> 'claimed'", "items"))
def enumerate_items(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    rows = i.withColumn("status", F.when(F.col("source_id").cast("long") % 11 == 0, "claimed").otherwise(F.col("status")))
    return status.enumerate_items(rows).select("export_id", "source_id")


@query("SELECT (c_custkey % 16)::VARCHAR AS export_id, c_custkey::VARCHAR AS source_id, '/out/' || c_name AS directory FROM customer WHERE c_custkey % 5 > 0")
def claims(s: SparkSession, d: str) -> DataFrame:
    """Claimed directories; every fifth claim has none."""
    c = table(s, d, "customer")
    facts = c.select((F.col("c_custkey") % 16).cast("string").alias("export_id"), F.col("c_custkey").cast("string").alias("source_id"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("/out/"), "c_name")).alias("directory"))
    return status.claims(status.claim_directories(views.items(s, d), facts, NOW)).select("export_id", "source_id", "directory")


@query(
    sql(
        f"""SELECT export_id, source_id, CASE WHEN k % 3 = 0 THEN 'source_missing' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'no_media' ELSE 'old note' END ELSE last_error END AS last_error,
  CASE WHEN k % 3 = 0 AND NOT (status = 'source_missing' AND k % 2 = 1) THEN {NOW} ELSE 1 END AS updated_at, output_path FROM (SELECT * REPLACE (CASE WHEN status = 'source_missing' THEN 'old note' ELSE last_error END AS last_error) FROM items)""",
        "items",
    )
)
def mark_source_missing(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    i = i.withColumn("last_error", F.when(F.col("status") == "source_missing", "old note").otherwise(F.col("last_error")))
    k = F.col("source_id").cast("long")
    facts = i.filter(k % 3 == 0).select(*status.KEY, F.when(k % 2 == 0, "no_media").otherwise("old note").alias("note"))
    return status.mark_source_missing(i, facts, NOW).select("export_id", "source_id", "status", "last_error", "updated_at", "output_path")


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN fresh AND missing THEN 'source_missing' WHEN fresh THEN 'pending' WHEN named AND missing THEN 'source_missing' WHEN named AND status IN ('source_missing', 'retired') THEN 'pending'
  WHEN NOT named AND status NOT IN ('done', 'retired') AND export_id <> '3' THEN 'retired' ELSE status END AS status
FROM (SELECT export_id, source_id, status, false AS fresh, k % 5 > 0 AS named, k % 4 = 0 AS missing FROM items
  UNION ALL SELECT (o_custkey % 16)::VARCHAR, 'n' || o_orderkey, NULL, true, true, o_orderkey % 4 = 0 FROM orders WHERE o_orderkey % 9 = 0)""",
        "items",
    )
)
def enroll_reconciliation(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    fact = lambda name: ((F.col("o_custkey") % 16).cast("string").alias("export_id"), name.alias("source_id"), F.lit(None).cast("string").alias("url"), F.when(k % 4 == 0, "no_media").alias("reason"))
    found = o.filter(k % 5 > 0).select(*fact(k.cast("string"))).unionByName(o.filter(k % 9 == 0).select(*fact(F.concat(F.lit("n"), k.cast("string")))))
    gaps = s.createDataFrame([("3",)], "export_id string")
    return status.enroll_reconciliation(i, found, gaps, "memory", NOW).select("export_id", "source_id", "status")


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN k % 10 = 9 THEN 'excluded' WHEN (due AND k % 2 = 0) THEN 'done' WHEN due THEN 'failed' WHEN status = 'done' AND k % 4 = 0 THEN 'pending' ELSE status END AS status,
  CASE WHEN due AND k % 10 <> 9 AND k % 2 = 1 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM (SELECT *, k % 10 <> 9 AND k % 6 < 4 AND (status IN ('pending', 'failed') AND retry_count < 3 OR status = 'done' AND k % 4 = 0) AS due FROM items)""",
        "items",
    )
)
def run_plan(s: SparkSession, d: str) -> DataFrame:
    """A run over the whole table: exclusions, finished items whose file is gone, and outcomes of two thirds of the rest."""
    i = views.items(s, d)
    k = F.col("source_id").cast("long")
    files = i.filter((F.col("status") == "done") & (k % 4 != 0)).select(F.col("output_path").alias("path"), "checksum", "bytes")
    outcomes = i.filter(k % 6 < 4).select(*status.KEY, F.when(k % 2 == 0, "done").otherwise("failed").alias("event"), F.concat(F.lit("/new/"), "source_id").alias("output_path"), F.sha2("source_id", 256).alias("checksum"), F.lit(1).cast("long").alias("bytes"), F.lit("why").alias("note"))
    after, _ = status.run_plan(i, i.filter(k % 10 == 9).select(*status.KEY), files, outcomes, NOW)
    return after.select("export_id", "source_id", "status", "retry_count")


@query(sql("SELECT export_id, source_id FROM items WHERE status = 'done' AND k % 2 = 1", "items"))
def outputs_elsewhere(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    odd = F.col("source_id").cast("long") % 2 == 1
    rows = i.withColumn("output_path", F.when(odd, F.regexp_replace("output_path", "^/out/", "/out/../other/")).otherwise(F.regexp_replace("output_path", "^/out/", "/out//./")))
    return status.elsewhere(rows, "/out/x/..").select("export_id", "source_id")


@query(
    sql(
        """SELECT export_id, kind, count(*) FILTER (status = 'done' AND k % 3 > 0) AS verified, count(*) FILTER (status = 'done' AND k % 3 = 0) AS sent_back, count(*) FILTER (status = 'pending' OR status = 'done' AND k % 3 = 0) AS pending,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'source_missing') AS source_missing, count(*) FILTER (status = 'retired') AS retired, count(*) FILTER (status = 'excluded') AS excluded FROM items GROUP BY ALL""",
        "items",
    )
)
def resume_report(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    files = i.filter("status = 'done' and cast(source_id as long) % 3 > 0").select(F.col("output_path").alias("path"), "checksum", "bytes")
    return status.resume_report(*status.resume(i, files, NOW))


@query(
    sql(
        """SELECT export_id, id, 'item' AS side FROM (SELECT DISTINCT export_id, id FROM units WHERE token = 'b') UNION ALL
SELECT export_id, token, 'gap' FROM first WHERE (export_id, token) NOT IN (SELECT (export_id, id) FROM units WHERE token = 'b')""",
        "messages",
    )
)
def named_set(s: SparkSession, d: str) -> DataFrame:
    """All that a chat run names: items with a file, and tokens without one."""
    messages, units = views.token_messages(s, d), views.token_units(s, d)
    items = units.filter("token = 'b'").select("export_id", F.col("id").alias("source_id"))
    gaps = reconcile.missing_tokens(messages, units).select("export_id", F.col("token").alias("source_id"))
    return reconcile.named_set(items, gaps).select("export_id", F.col("source_id").alias("id"), "side")
