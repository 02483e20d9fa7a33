"""The driver's tables seen as parts of archives: entries, media, messages, tokens, items, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.sources.tables import dealt_by_size, table

STATUS_NOW = 1_700_000_000
#: Lines of orders in a task that makes messages of them.
LINES = 250_000


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as manifest entries of 16 exports; the customer's nation gives a point, none for every eleventh."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    kind = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), "image").when(F.left("o_orderpriority", F.lit(1)).isin("3", "4"), "video").otherwise("unknown")
    place = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("c_nationkey").cast("double"))
    return o.select((F.col("o_custkey") % 16).cast("string").alias("export_id"), F.col("o_orderkey").alias("entry_index"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), kind.alias("kind"), place.alias("lat"), (-place).alias("lon"))


def media(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as media files; the id is a digest of the whole row."""
    li = table(spark, d, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    uuid = F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd")))
    return li.select((F.col("l_suppkey") % 16).cast("string").alias("export_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.when(F.col("l_linestatus") == "F", "image").otherwise("video").alias("kind"), uuid.alias("uuid"))


def token_messages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as messages that name the parts of their lines as media."""
    # a line is sorted with its order, the order and the tokens of a task: tasks of a fixed size bound all three
    lines = dealt_by_size(table(spark, d, "lineitem"), LINES, "l_orderkey")
    li = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    ids = F.array_join(F.transform("p", lambda s: F.concat(F.when(s["l_partkey"] % 50 == 0, "?").when(s["l_partkey"] % 3 == 0, "B~").otherwise("b~"), s["l_partkey"].cast("string"))), " | ")
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select((F.col("o_custkey") % 4).cast("string").alias("export_id"), F.col("o_custkey").cast("string").alias("conversation"), F.col("o_orderkey").alias("pos"), ids.alias("media_ids"))


def token_units(spark: SparkSession, d: str) -> DataFrame:
    """Parts as chat media files of four exports; some sizes are of other tokens."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    token = F.when(F.col("p_size") % 7 == 0, "media").otherwise("b")
    exports = F.explode(F.array(*(F.lit(str(i)) for i in range(4)))).alias("export_id")
    return p.select(exports, F.concat(token, F.lit("~"), key).alias("id"), token.alias("token"), F.lit("plain").alias("family"))


def overlay_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines as memory files: orders are ids, even lines are mains and odd ones overlays; ids repeat."""
    li = table(spark, d, "lineitem")
    role = F.when(F.col("l_linenumber") % 2 == 0, "main").otherwise("overlay")
    path = F.concat_ws("/", F.lit("memories"), F.col("l_orderkey").cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".jpg")))
    return li.select((F.col("l_orderkey") % 8).cast("string").alias("export_id"), F.col("l_orderkey").cast("string").alias("uuid"), role.alias("role"), path.alias("path"))


def histories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as chat and snap histories; a seventh has no stated time, a thirteenth no epoch."""
    e = table(spark, d, "events")
    chat = F.col("event_type").isin("view", "click")
    stamp = F.struct(*(getattr(F, p)("ts").alias(p) for p in ("year", "month", "day", "hour", "minute", "second")))
    rows = e.select(
        (F.col("user_id") % 8).cast("string").alias("export_id"), F.col("user_id").cast("string").alias("conversation"), F.when(chat, "chat").otherwise("snap").alias("source"), F.col("event_id").alias("pos"),
        F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("sender"), F.upper("event_type").alias("media_type"), F.when(F.col("event_id") % 7 != 0, stamp).alias("created"),
        F.when(F.col("event_id") % 13 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("created_epoch_ms"), F.when(chat, F.col("props")).alias("content"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), (F.col("event_id") % 17).cast("string"))).alias("title"),
        (F.col("event_id") % 2 == 0).alias("is_sender"), F.lit(None).cast("string").alias("media_ids"),
    )
    return rows.filter("source = 'chat'"), rows.filter("source = 'snap'")


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a timeline; every third text opens with a sign that a spreadsheet would run."""
    c = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('="'), "text")).otherwise(F.col("text"))
    none = F.lit(None).cast("string")
    stamp = F.struct(*(F.lit(v).alias(n) for v, n in ((2020, "year"), (2, "month"), (30, "day"))), (F.col("turn") % 24).cast("int").alias("hour"), (F.col("turn") % 60).cast("int").alias("minute"), F.lit(0).alias("second"))
    return c.select(
        (F.col("conv_id") % 4).cast("string").alias("export_id"), F.col("conv_id").cast("string").alias("conversation"), F.lit("chat").alias("source"), F.col("turn").alias("pos"), F.col("role").alias("sender"),
        F.lit("TEXT").alias("media_type"), F.when(F.col("turn") % 5 != 0, stamp).alias("resolved"), text.alias("content"), F.when(F.col("turn") == 1, F.concat(F.lit("<"), "role", F.lit(">"))).alias("title"),
        (F.col("role") == "user").alias("is_sender"), none.alias("media_ids"), (F.col("turn") + 1).cast("int").alias("seq"), F.lit(None).cast("long").alias("created_epoch_ms"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a status table: most statuses, records on done rows."""
    o = table(spark, d, "orders")
    m = F.col("o_orderkey") % 7
    status = F.when(m < 2, "done").when(m == 2, "pending").when(m == 3, "failed").when(m == 4, "source_missing").when(m == 5, "retired").otherwise("excluded")
    done = m < 2
    key = F.col("o_orderkey").cast("string")
    return o.select(
        (F.col("o_custkey") % 16).cast("string").alias("export_id"), F.lit("memory").alias("kind"), key.alias("source_id"), status.alias("status"), F.when(m == 3, (F.col("o_orderkey") % 4).cast("int")).otherwise(0).alias("retry_count"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://h/"), F.md5(key))).alias("url"), F.when(done, F.concat(F.lit("/out/"), key, F.lit(".jpg"))).alias("output_path"), F.when(done, F.sha2(key, 256)).alias("checksum"),
        F.when(done, F.col("o_orderkey")).alias("bytes"), F.when(m == 3, "old note").alias("last_error"), F.lit(1).cast("long").alias("updated_at"),
    )


#: The same views in DuckDB.
SQL = {
    "entries": """entries AS (SELECT (o_custkey % 16)::VARCHAR AS export_id, o_orderkey AS entry_index, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'image' WHEN o_orderpriority[1] IN ('3', '4') THEN 'video' ELSE 'unknown' END AS kind,
  CASE WHEN o_orderkey % 11 <> 0 THEN c_nationkey::DOUBLE END AS lat, CASE WHEN o_orderkey % 11 <> 0 THEN -c_nationkey::DOUBLE END AS lon
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "media": """media AS (SELECT (l_suppkey % 16)::VARCHAR AS export_id, strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE WHEN l_linestatus = 'F' THEN 'image' ELSE 'video' END AS kind,
  md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR,
    round(l_discount * 100)::BIGINT::VARCHAR, round(l_tax * 100)::BIGINT::VARCHAR, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS uuid
  FROM lineitem)""",
    "pairs": """e AS (SELECT *, row_number() OVER (PARTITION BY export_id, day, kind ORDER BY entry_index) AS rn, count(*) OVER (PARTITION BY export_id, day, kind) AS en FROM entries),
m AS (SELECT *, row_number() OVER (PARTITION BY export_id, day, kind ORDER BY uuid) AS rn, count(*) OVER (PARTITION BY export_id, day, kind) AS mn FROM media),
pairs AS (SELECT export_id, day, kind, entry_index, uuid, CASE WHEN en = 1 AND mn = 1 THEN 'exact' ELSE 'ambiguous' END AS confidence, lat, lon FROM e JOIN m USING (export_id, day, kind, rn))""",
    "messages": """parts AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
tokens AS (SELECT (o_custkey % 4)::VARCHAR AS export_id, o_custkey::VARCHAR AS conversation, o_orderkey AS pos, i AS token_pos,
  CASE WHEN l_partkey % 50 = 0 THEN '?' || l_partkey WHEN l_partkey % 3 = 0 THEN 'B~' || l_partkey ELSE 'b~' || l_partkey END AS spelling,
  CASE WHEN l_partkey % 50 <> 0 THEN 'b~' || l_partkey END AS token FROM orders JOIN parts ON o_orderkey = l_orderkey),
first AS (SELECT export_id, token, min(ROW(conversation, pos, token_pos)) AS f FROM tokens WHERE token IS NOT NULL GROUP BY ALL),
units AS (SELECT x.export_id, CASE WHEN p_size % 7 = 0 THEN 'media' ELSE 'b' END AS token, CASE WHEN p_size % 7 = 0 THEN 'media' ELSE 'b' END || '~' || p_partkey AS id
  FROM part, (SELECT unnest(['0', '1', '2', '3']) AS export_id) x)""",
    "files": """files AS (SELECT (l_orderkey % 8)::VARCHAR AS export_id, l_orderkey::VARCHAR AS uuid, CASE WHEN l_linenumber % 2 = 0 THEN 'main' ELSE 'overlay' END AS role,
  'memories/' || l_orderkey || '/' || l_linenumber || '-' || l_suppkey || '.jpg' AS path FROM lineitem),
claims AS (SELECT export_id, uuid, role, list_sort(list(path)) AS paths FROM files GROUP BY ALL)""",
    "timeline": """h AS (SELECT (user_id % 8)::VARCHAR AS export_id, user_id::VARCHAR AS conversation, CASE WHEN event_type IN ('view', 'click') THEN 'chat' ELSE 'snap' END AS source, event_id AS pos,
  CASE WHEN event_id % 7 <> 0 OR event_id % 13 <> 0 THEN date_trunc('second', ts) END AS resolved, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000 END AS created_epoch_ms,
  CASE WHEN event_id % 3 = 0 THEN 'T' || (event_id % 17) END AS title FROM events),
timeline AS (SELECT *, row_number() OVER (PARTITION BY export_id, conversation ORDER BY resolved NULLS LAST, created_epoch_ms NULLS FIRST, source, pos) AS seq FROM h)""",
    "transcript": """t AS (SELECT (conv_id % 4)::VARCHAR AS export_id, conv_id::VARCHAR AS conversation, turn + 1 AS seq, role,
  CASE WHEN turn % 3 = 0 THEN '="' || text ELSE text END AS content, CASE WHEN turn = 1 THEN '<' || role || '>' END AS title,
  CASE WHEN turn % 5 <> 0 THEN printf('2020-02-30 %02d:%02d:00 UTC', turn % 24, turn % 60) END AS created FROM conversations)""",
    "items": """items AS (SELECT (o_custkey % 16)::VARCHAR AS export_id, 'memory' AS kind, o_orderkey::VARCHAR AS source_id,
  CASE WHEN o_orderkey % 7 < 2 THEN 'done' WHEN o_orderkey % 7 = 2 THEN 'pending' WHEN o_orderkey % 7 = 3 THEN 'failed' WHEN o_orderkey % 7 = 4 THEN 'source_missing' WHEN o_orderkey % 7 = 5 THEN 'retired' ELSE 'excluded' END AS status,
  CASE WHEN o_orderkey % 7 = 3 THEN (o_orderkey % 4)::INT ELSE 0 END AS retry_count, CASE WHEN o_orderkey % 3 = 0 THEN 'https://h/' || md5(o_orderkey::VARCHAR) END AS url,
  CASE WHEN o_orderkey % 7 < 2 THEN '/out/' || o_orderkey || '.jpg' END AS output_path, CASE WHEN o_orderkey % 7 < 2 THEN sha256(o_orderkey::VARCHAR) END AS checksum,
  CASE WHEN o_orderkey % 7 < 2 THEN o_orderkey END AS bytes, CASE WHEN o_orderkey % 7 = 3 THEN 'old note' END AS last_error, 1::BIGINT AS updated_at, o_orderkey AS k, o_orderstatus
  FROM orders)""",
}


def sql(select: str, *views: str) -> str:
    return "WITH " + ",\n".join(SQL[v] for v in views) + "\n" + select
