"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators import plan, reconcile, redact, reports, status, timeline, zones
from heronry.plans import views
from heronry.plans.views import sql
from heronry.sources.tables import table

FLAGSHIP = "reconcile_report"
NOW = views.STATUS_NOW
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# ---- reconciliation ----


@query(sql("SELECT export_id, day, kind, entry_index, uuid, confidence FROM pairs", "entries", "media", "pairs"))
def bucket_match(s: SparkSession, d: str) -> DataFrame:
    pairs, _, _ = reconcile.bucket_match(views.entries(s, d), views.media(s, d))
    return pairs.select("export_id", "day", "kind", "entry.entry_index", "media.uuid", "confidence")


@query(
    sql(
        """SELECT coalesce(a.export_id, b.export_id) AS export_id, coalesce(entries, 0) AS entries, coalesce(exact, 0) AS exact, coalesce(ambiguous, 0) AS ambiguous, coalesce(no_media, 0) AS no_media,
  coalesce(no_date, 0) AS no_date, coalesce(scan_incomplete, 0) AS scan_incomplete, coalesce(paired, 0) AS paired, coalesce(files, 0) AS files, coalesce(files, 0) - coalesce(paired, 0) AS unclaimed
FROM (SELECT en.export_id, count(*) AS entries, count(*) FILTER (confidence = 'exact') AS exact, count(*) FILTER (confidence = 'ambiguous') AS ambiguous,
    count(*) FILTER (uuid IS NULL AND en.day IS NOT NULL AND en.export_id <> '3') AS no_media, count(*) FILTER (en.day IS NULL) AS no_date,
    count(*) FILTER (uuid IS NULL AND en.day IS NOT NULL AND en.export_id = '3') AS scan_incomplete, count(uuid) AS paired
  FROM entries en LEFT JOIN pairs USING (entry_index) GROUP BY 1) a
FULL JOIN (SELECT export_id, count(*) AS files FROM media GROUP BY 1) b ON a.export_id = b.export_id""",
        "entries", "media", "pairs",
    )
)
def reconcile_report(s: SparkSession, d: str) -> DataFrame:
    entries, media = views.entries(s, d), views.media(s, d)
    pairs, left, _ = reconcile.bucket_match(entries, media)
    gaps = s.createDataFrame([("3",)], "export_id string")
    gone = reconcile.missing_reason(left, gaps, F.col("day")).select("export_id", "entry_index", F.lit(None).cast("string").alias("uuid"), F.lit("missing").alias("confidence"), "reason")
    items = pairs.select("export_id", "entry.entry_index", "media.uuid", "confidence", F.lit(None).cast("string").alias("reason")).unionByName(gone)
    return reports.reconcile_report(items, media)


@query(
    sql(
        """left_e AS (SELECT e.export_id, e.kind, e.day::DATE AS d, entry_index FROM e LEFT JOIN m USING (export_id, day, kind, rn) WHERE m.uuid IS NULL),
left_m AS (SELECT m.export_id, m.kind, m.day::DATE AS d, uuid, row_number() OVER (PARTITION BY m.export_id, m.kind, m.day ORDER BY uuid) AS rank FROM m LEFT JOIN e USING (export_id, day, kind, rn) WHERE e.entry_index IS NULL),
days AS (SELECT export_id, kind, d, sum(ne)::INT AS ne, sum(nm)::INT AS nm FROM (SELECT export_id, kind, d, 1 AS ne, 0 AS nm FROM left_e UNION ALL SELECT export_id, kind, d, 0, 1 FROM left_m) GROUP BY ALL),
marked AS (SELECT *, coalesce(d - lag(d) OVER w = 1 AND ((ne > 0 AND lag(nm) OVER w > 0) OR (nm > 0 AND lag(ne) OVER w > 0)), false) AS tied FROM days WINDOW w AS (PARTITION BY export_id, kind ORDER BY d)),
chains AS (SELECT *, sum(CASE WHEN tied THEN 0 ELSE 1 END) OVER (PARTITION BY export_id, kind ORDER BY d ROWS UNBOUNDED PRECEDING) AS chain FROM marked),
state AS (SELECT export_id, kind, chain, min(d) AS first_day, list(nm ORDER BY d) AS have, sum(ne) AS asks FROM chains GROUP BY ALL HAVING count(*) > 1),
asking AS (SELECT l.export_id, l.kind, c.chain, entry_index, (l.d - s.first_day)::INT + 1 AS p, row_number() OVER (PARTITION BY l.export_id, l.kind, c.chain ORDER BY entry_index) AS r
  FROM left_e l JOIN chains c ON l.export_id = c.export_id AND l.kind = c.kind AND l.d = c.d JOIN state s ON s.export_id = c.export_id AND s.kind = c.kind AND s.chain = c.chain),
walk AS (SELECT export_id, kind, chain, 0::BIGINT AS r, have, NULL::BIGINT AS entry_index, NULL::INT AS spot, NULL::INT AS rank FROM state
  UNION ALL SELECT export_id, kind, chain, r, list_transform(have, lambda n, i: CASE WHEN i = spot THEN n - 1 ELSE n END), entry_index, spot, CASE WHEN spot IS NOT NULL THEN have[spot] END
  FROM (SELECT w.export_id, w.kind, w.chain, a.r, w.have, a.entry_index, CASE WHEN coalesce(w.have[a.p + 1], 0) > 0 THEN a.p + 1 WHEN a.p > 1 AND w.have[a.p - 1] > 0 THEN a.p - 1 END AS spot
    FROM walk w JOIN asking a ON w.export_id = a.export_id AND w.kind = a.kind AND w.chain = a.chain AND a.r = w.r + 1)),
moved AS (SELECT w.export_id, entry_index, uuid FROM walk w JOIN state s USING (export_id, kind, chain)
  JOIN left_m l ON l.export_id = w.export_id AND l.kind = w.kind AND l.d = s.first_day + (spot - 1) AND l.rank = s.have[spot] - w.rank + 1 WHERE spot IS NOT NULL)
SELECT export_id, day, kind, entry_index, uuid, confidence, reason, coalesce(uuid, 'unpaired-entry-' || entry_index) AS source_id FROM (
  SELECT export_id, day, kind, entry_index, uuid, confidence, NULL AS reason FROM pairs UNION ALL
  SELECT e.export_id, e.day, e.kind, e.entry_index, moved.uuid, CASE WHEN moved.uuid IS NULL THEN 'missing' ELSE 'ambiguous' END,
    CASE WHEN moved.uuid IS NULL THEN CASE WHEN e.export_id = '3' THEN 'scan_incomplete' ELSE 'no_media' END END
  FROM e JOIN left_e USING (export_id, kind, entry_index) LEFT JOIN moved ON moved.export_id = e.export_id AND moved.entry_index = e.entry_index)""",
        "entries", "media", "pairs",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("\nleft_e AS", ",\nleft_e AS", 1)
)
def memory_items(s: SparkSession, d: str) -> DataFrame:
    gaps = s.createDataFrame([("3",)], "export_id string")
    return reconcile.memory_items(views.entries(s, d), views.media(s, d), gaps)


@query(
    sql(
        """SELECT * FROM (WITH days AS (SELECT DISTINCT export_id, kind, day::DATE AS d FROM media), g AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY export_id, kind ORDER BY d) > 1 THEN 1 ELSE 0 END AS new FROM days)
SELECT export_id, kind, island, count(*) AS days, min(d)::VARCHAR AS first_day, max(d)::VARCHAR AS last_day
FROM (SELECT *, sum(new) OVER (PARTITION BY export_id, kind ORDER BY d ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g) GROUP BY ALL)""",
        "media",
    )
)
def day_islands(s: SparkSession, d: str) -> DataFrame:
    rows = reconcile.islands(views.media(s, d)).select("export_id", "kind", "island", "day").distinct()
    return rows.groupBy("export_id", "kind", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_AGREED = """agreement AS (SELECT export_id, day, kind, count(*) AS n, coalesce(count(lat) = count(*) AND min(lat) = max(lat) AND min(lon) = max(lon), false) AS agreed,
  CASE WHEN agreed THEN min(lat) END AS lat, CASE WHEN agreed THEN min(lon) END AS lon FROM entries GROUP BY 1, 2, 3)"""
views.SQL["agreement"] = _AGREED


@query(sql("SELECT * FROM agreement", "entries", "agreement"))
def bucket_agreement(s: SparkSession, d: str) -> DataFrame:
    return reconcile.bucket_agreement(views.entries(s, d))


@query(
    sql(
        """SELECT export_id, entry_index, uuid, CASE WHEN confidence = 'exact' THEN p.lat ELSE a.lat END AS out_lat, CASE WHEN confidence = 'exact' THEN p.lon ELSE a.lon END AS out_lon
FROM pairs p LEFT JOIN agreement a USING (export_id, day, kind)""",
        "entries", "media", "pairs", "agreement",
    )
)
def permitted_location(s: SparkSession, d: str) -> DataFrame:
    entries = views.entries(s, d)
    pairs, _, _ = reconcile.bucket_match(entries, views.media(s, d))
    flat = pairs.select("export_id", "day", "kind", "entry.entry_index", "entry.lat", "entry.lon", "media.uuid", "confidence")
    return reconcile.permitted_location(flat, reconcile.bucket_agreement(entries)).select("export_id", "entry_index", "uuid", "out_lat", "out_lon")


@query(
    sql(
        """SELECT u.export_id, u.id, CASE WHEN u.token <> 'b' THEN 'no_token' WHEN f IS NULL THEN 'unnamed' ELSE 'named' END AS outcome, f[1] AS conversation, f[2]::VARCHAR AS pos, f[3]::VARCHAR AS token_pos
FROM units u LEFT JOIN first ON u.export_id = first.export_id AND u.id = first.token""",
        "messages",
    )
)
def token_join(s: SparkSession, d: str) -> DataFrame:
    out = reconcile.token_join(views.token_messages(s, d), views.token_units(s, d))
    return out.select("export_id", "id", "outcome", "conversation", F.col("pos").cast("string").alias("pos"), F.col("token_pos").cast("string").alias("token_pos"))


@query(sql("SELECT export_id, token, f[1] AS conversation, 'no_file' AS reason FROM first WHERE (export_id, token) NOT IN (SELECT (export_id, id) FROM units WHERE token = 'b')", "messages"))
def missing_tokens(s: SparkSession, d: str) -> DataFrame:
    return reconcile.missing_tokens(views.token_messages(s, d), views.token_units(s, d))


@query(sql("SELECT export_id, token, f[1] AS conversation FROM first", "messages"))
def history_attribution(s: SparkSession, d: str) -> DataFrame:
    return reconcile.history_attribution(views.token_messages(s, d))


@query(sql("SELECT export_id, spelling, min(ROW(conversation, pos, token_pos))[1] AS conversation FROM tokens WHERE token IS NULL GROUP BY ALL", "messages"))
def unparsed_tokens(s: SparkSession, d: str) -> DataFrame:
    return reconcile.unparsed_tokens(views.token_messages(s, d))


@query(sql("SELECT export_id, uuid, m.paths[1] AS main_path, o.paths[1] AS overlay_path FROM (SELECT * FROM claims WHERE role = 'main') m LEFT JOIN (SELECT * FROM claims WHERE role = 'overlay') o USING (export_id, uuid)", "files"))
def pair_overlays(s: SparkSession, d: str) -> DataFrame:
    return reconcile.pair_overlays(views.overlay_files(s, d))[0].select("export_id", "uuid", "main_path", "overlay_path")


@query(sql("SELECT export_id, uuid, paths[1] AS path FROM claims c WHERE role = 'overlay' AND NOT EXISTS (SELECT 1 FROM claims m WHERE m.role = 'main' AND m.export_id = c.export_id AND m.uuid = c.uuid)", "files"))
def orphan_overlays(s: SparkSession, d: str) -> DataFrame:
    return reconcile.pair_overlays(views.overlay_files(s, d))[1].select("export_id", "uuid", "path")


@query(sql("SELECT export_id, uuid, role, paths[1] AS kept, array_to_string(paths[2:], ',') AS ignored FROM claims WHERE len(paths) > 1", "files"))
def duplicate_files(s: SparkSession, d: str) -> DataFrame:
    out = reconcile.duplicates(views.overlay_files(s, d))[1]
    return out.withColumn("ignored", F.array_join("ignored", ","))


@query(
    """SELECT v.vec_id AS id, min(z.zone) AS zone FROM (SELECT vec_id, (embedding[1]::DOUBLE * 90) AS lat, (embedding[2]::DOUBLE * 180) AS lon FROM embeddings) v
LEFT JOIN (SELECT n_name AS zone, (n_nationkey % 5) * 12 - 30 AS a, (n_nationkey // 5) * 24 - 60 AS b FROM nation) z ON v.lat BETWEEN a AND a + 15 AND v.lon BETWEEN b AND b + 30 GROUP BY 1"""
)
def assign_zone(s: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    points = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (at(1) * 90).alias("lat"), (at(2) * 180).alias("lon"))
    a, b = (F.col("n_nationkey") % 5) * 12 - 30, F.floor(F.col("n_nationkey") / 5) * 24 - 60
    boxes = table(s, d, "nation").select(F.col("n_name").alias("zone"), a.alias("min_lat"), (a + 15).alias("max_lat"), b.alias("min_lon"), (b + 30).alias("max_lon"))
    return zones.assign_zone(points, boxes).select("id", "zone")


# ---- timelines and transcripts ----


@query(sql("SELECT export_id, conversation, source, pos, seq FROM timeline", "timeline"))
def timeline_merge(s: SparkSession, d: str) -> DataFrame:
    merged = timeline.merge_timeline(*views.histories(s, d))
    return merged.select("export_id", "conversation", "source", "pos", F.col("seq").cast("long").alias("seq"))


@query(sql("SELECT export_id, conversation, arg_min(title, seq) FILTER (title IS NOT NULL) AS title FROM timeline GROUP BY ALL", "timeline"))
def conversation_title(s: SparkSession, d: str) -> DataFrame:
    return timeline.conversation_title(timeline.merge_timeline(*views.histories(s, d)))


def _document(fmt: str) -> Query:
    return lambda s, d: timeline.documents(views.transcript(s, d), fmt).select("export_id", "conversation", F.md5("document").alias("digest"), F.length("document").cast("long").alias("n_chars"))


_DIGEST = ", md5(doc) AS digest, len(doc) AS n_chars FROM (SELECT export_id, conversation, {} AS doc FROM {} GROUP BY ALL)"
_FIELD = "CASE WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_GUARDED = "(CASE WHEN regexp_matches(content, '^[=+\\-@\\t\\r]') THEN chr(39) || content ELSE content END)"
QUERIES["transcript_csv"] = _document("csv")
ORACLE_SQL["transcript_csv"] = sql(
    "SELECT export_id, conversation" + _DIGEST.format(f"'{timeline.CSV_HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10)", "(SELECT *, 'chat,' || role || ',' || CASE WHEN role = 'user' THEN 'true' ELSE 'false' END || ',TEXT,' || coalesce(created, '') || ',' || " + _FIELD.format(_GUARDED) + " || ',,' || coalesce(title, '') AS line FROM t)"),
    "transcript",
)
QUERIES["transcript_text"] = _document("text")
ORACLE_SQL["transcript_text"] = sql(
    "SELECT export_id, conversation"
    + _DIGEST.format(
        "string_agg(block, chr(10) ORDER BY seq)",
        """(SELECT *, '[' || coalesce(created, 'no date') || '] ' || role || ' (chat TEXT, ' || CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END || ')' || chr(10) ||
  CASE WHEN content = '' THEN '' ELSE array_to_string(list_transform(string_split(regexp_replace(content, '\\n$', ''), chr(10)), lambda l: '> ' || regexp_replace(l, '\\r$', '') || chr(10)), '') END AS block FROM t)""",
    ),
    "transcript",
)
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
QUERIES["transcript_html"] = _document("html")
ORACLE_SQL["transcript_html"] = sql(
    "SELECT export_id, conversation"
    + _DIGEST.format(
        "'<!doctype html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head>' || chr(10) || '<meta charset=\"utf-8\">' || chr(10) || '<title>' || " + _ESCAPED.format("coalesce(arg_min(title, seq) FILTER (title IS NOT NULL), any_value(conversation))") + " || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(block, '' ORDER BY seq) || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)",
        "(SELECT *, '<article><p><span class=\"time\">' || coalesce(created, '') || '</span> ' || " + _ESCAPED.format("role") + " || ' (<span class=\"kind\">chat</span> <span class=\"media-type\">TEXT</span>, ' || CASE WHEN role = 'user' THEN 'sent' ELSE 'received' END || ')</p>' || CASE WHEN content <> '' THEN '<p class=\"body\" style=\"white-space: pre-wrap\">' || " + _ESCAPED.format("content") + " || '</p>' ELSE '' END || '</article>' AS block FROM t)",
    ),
    "transcript",
)


@query(sql("SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY label, conversation) AS place FROM (SELECT export_id, conversation, lower(coalesce(arg_min(title, seq) FILTER (title IS NOT NULL), any_value(conversation))) AS label FROM timeline GROUP BY ALL)", "timeline"))
def conversation_picker(s: SparkSession, d: str) -> DataFrame:
    return timeline.picker(timeline.merge_timeline(*views.histories(s, d))).select("export_id", "conversation", F.lower("label").alias("label"), F.col("place").cast("long").alias("place"))


# ---- planning ----

_STEMS = """p AS (SELECT (user_id % 8)::VARCHAR AS export_id, event_id, '/out/' || strftime(ts, '%Y/%m') AS dir, strftime(ts, '%Y%m%d_%H') || '0000' AS stem, CASE WHEN event_type = 'view' THEN 'jpg' ELSE 'mp4' END AS ext FROM events),
r AS (SELECT export_id, event_id, dir || '/' || stem || '.' || ext AS path, dir || '/' || stem || '.' || ext AS g FROM p WHERE event_id % 29 = 0),
own AS (SELECT export_id, path, min_by(event_id, event_id::VARCHAR) AS event_id FROM r GROUP BY ALL)"""


@query(
    f"""WITH {_STEMS}, n AS (SELECT p.*, dir || '/' || stem || '.' || ext AS g, row_number() OVER (PARTITION BY p.export_id, dir, stem, ext ORDER BY event_id) AS k FROM p WHERE (export_id, event_id) NOT IN (SELECT (export_id, event_id) FROM own))
SELECT n.export_id, n.event_id::VARCHAR AS source_id, CASE WHEN o.path IS NULL AND k = 1 THEN dir || '/' || stem || '.' || ext ELSE dir || '/' || stem || '_' || (CASE WHEN o.path IS NULL THEN k ELSE k + 1 END) || '.' || ext END AS output_path, false AS adopted
FROM n LEFT JOIN own o ON n.export_id = o.export_id AND n.g = o.path UNION ALL SELECT export_id, event_id::VARCHAR, path, true FROM own"""
)
def allocate_paths(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    rows = e.select((F.col("user_id") % 8).cast("string").alias("export_id"), F.col("event_id").cast("string").alias("source_id"), "event_id", F.concat(F.lit("/out/"), F.date_format("ts", "yyyy/MM")).alias("dir"), F.concat(F.date_format("ts", "yyyyMMdd_HH"), F.lit("0000")).alias("stem"), F.when(F.col("event_type") == "view", "jpg").otherwise("mp4").alias("ext"))
    recorded = rows.filter("event_id % 29 = 0").select("export_id", "source_id", F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext").alias("output_path"))
    return plan.allocate_paths(rows, recorded, ["event_id"]).select("export_id", "source_id", "output_path", "adopted")


_DIR = "CASE WHEN t = '' THEN '_unnamed' WHEN lower(string_split(t, '.')[1]) IN ({}) THEN '_' || t ELSE t END".format(", ".join(f"'{r}'" for r in x.RESERVED_STEMS))


@query(f"SELECT page_id, {_DIR} AS dir FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g')[:64], '^\\.+', ''), '\\.+$', '') AS t FROM pages)")
def dir_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", x.dir_name(F.col("url")).alias("dir"))


_CONVERSATIONS = "SELECT DISTINCT (page_id % 4)::VARCHAR AS export_id, regexp_replace(url, '[0-9?=&].*$', '') || repeat('?', (page_id % 3)::INT) AS conversation FROM pages"


@query(
    f"""WITH k AS ({_CONVERSATIONS}), n AS (SELECT export_id, conversation, {_DIR} AS name FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(conversation, '[^A-Za-z0-9._-]', '_', 'g')[:64], '^\\.+', ''), '\\.+$', '') AS t FROM k)),
r AS (SELECT *, row_number() OVER (PARTITION BY export_id, lower(name) ORDER BY conversation) AS i FROM n)
SELECT export_id, conversation, name || CASE WHEN i > 1 THEN '_' || i ELSE '' END AS dir, false AS adopted FROM r"""
)
def allocate_dirs(s: SparkSession, d: str) -> DataFrame:
    more = F.repeat(F.lit("?"), (F.col("page_id") % 3).cast("int"))
    keys = table(s, d, "pages").select((F.col("page_id") % 4).cast("string").alias("export_id"), F.concat(F.regexp_replace("url", "[0-9?=&].*$", ""), more).alias("conversation"))
    return plan.allocate_dirs(keys)


# ---- status ----


@query(
    sql(
        """SELECT coalesce(i.export_id, n.export_id) AS export_id, coalesce(i.source_id, n.source_id) AS source_id, coalesce(status, 'pending') AS status, coalesce(n.url, i.url) AS url,
  CASE WHEN i.source_id IS NULL OR (n.url IS NOT NULL AND i.url IS DISTINCT FROM n.url) THEN 1700000000 ELSE updated_at END AS updated_at
FROM items i FULL JOIN (SELECT (o_custkey % 16)::VARCHAR AS export_id, CASE WHEN o_orderkey % 10 = 3 THEN 'n' ELSE '' END || o_orderkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://n/' || o_orderkey END AS url FROM orders WHERE o_orderstatus <> 'P') n
ON i.export_id = n.export_id AND i.source_id = n.source_id""",
        "items",
    )
)
def enroll(s: SparkSession, d: str) -> DataFrame:
    return status.enroll(views.items(s, d), _second_run(s, d), NOW).select("export_id", "source_id", "status", "url", "updated_at")


def _second_run(s: SparkSession, d: str) -> DataFrame:
    """A later delivery: orders of one status are gone, a tenth of the others has new names."""
    o = table(s, d, "orders").filter("o_orderstatus <> 'P'")
    key = F.col("o_orderkey").cast("string")
    name = F.concat(F.when(F.col("o_orderkey") % 10 == 3, "n").otherwise(""), key)
    return o.select((F.col("o_custkey") % 16).cast("string").alias("export_id"), F.lit("memory").alias("kind"), name.alias("source_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://n/"), key)).alias("url"))


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN hit THEN 'retired' ELSE status END AS status, CASE WHEN hit THEN 'the export no longer holds a source for this item' ELSE last_error END AS last_error, output_path
FROM (SELECT *, (o_orderstatus = 'P' OR k % 10 = 3) AND status NOT IN ('done', 'retired') AND export_id <> '3' AS hit FROM items)""",
        "items",
    )
)
def retire_absent(s: SparkSession, d: str) -> DataFrame:
    gaps = views.items(s, d).filter("export_id = '3'").select("export_id")
    return status.retire_absent(views.items(s, d), _second_run(s, d), gaps, "memory", NOW).select("export_id", "source_id", "status", "last_error", "output_path")


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN k % 5 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN k % 5 = 0 THEN 0 ELSE retry_count END AS retry_count, CASE WHEN k % 5 <> 0 THEN output_path END AS output_path, url FROM items""",
        "items",
    )
)
def reset(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    return status.reset(i, i.filter("cast(source_id as long) % 5 = 0").select(*status.KEY), NOW).select("export_id", "source_id", "status", "retry_count", "output_path", "url")


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE status END AS status, retry_count + (k % 3 = 0)::INT AS retry_count,
  CASE WHEN k % 3 = 0 THEN 'cannot read <redacted> today' ELSE last_error END AS last_error, CASE WHEN k % 3 <> 0 THEN checksum END AS checksum FROM items""",
        "items",
    )
)
def mark_failed(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    facts = i.filter("cast(source_id as long) % 3 = 0").select(*status.KEY, F.concat(F.lit("cannot read "), F.md5("source_id"), F.lit(" today")).alias("note"))
    return status.mark_failed(i, facts, NOW).select("export_id", "source_id", "status", "retry_count", "last_error", "checksum")


@query(sql("SELECT export_id, kind, " + ", ".join(f"count(*) FILTER (status = '{w}') AS {w}" for w in x.ITEM_STATUSES) + ", count(*) AS total FROM items GROUP BY ALL", "items"))
def status_counts(s: SparkSession, d: str) -> DataFrame:
    return status.status_counts(views.items(s, d))


@query(sql("SELECT export_id, source_id, status, retry_count FROM items WHERE status IN ('pending', 'failed') AND retry_count < 3", "items"))
def work_list(s: SparkSession, d: str) -> DataFrame:
    return status.work_list(views.items(s, d)).select("export_id", "source_id", "status", "retry_count")


@query(
    sql(
        """SELECT export_id, source_id, CASE WHEN bytes % 4 = 0 THEN 'vanished' WHEN bytes % 4 = 1 THEN 'unreadable' WHEN bytes % 4 = 2 THEN 'changed' ELSE 'verified' END AS verdict FROM items WHERE status = 'done'""",
        "items",
    )
)
def resume_verdicts(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    m = F.col("bytes") % 4
    files = i.filter("status = 'done' and bytes % 4 <> 0").select(F.col("output_path").alias("path"), F.when(m == 1, None).when(m == 2, "other").otherwise(F.col("checksum")).alias("checksum"), "bytes")
    return status.resume(i, files, NOW)[1].select("export_id", "source_id", "verdict")


@query(
    """WITH e AS (SELECT (user_id % 8)::VARCHAR AS export_id, user_id::VARCHAR AS source_id, event_id AS seq, CASE event_id % 9 WHEN 0 THEN 'reset' WHEN 1 THEN 'missing' WHEN 2 THEN 'done' ELSE 'failed' END AS event FROM events),
g AS (SELECT export_id, source_id, max(seq) FILTER (event = 'reset') AS reset_at, arg_max(event, seq) AS last, count(*) AS n_events FROM e GROUP BY ALL),
f AS (SELECT export_id, source_id, last, n_events, count(*) FILTER (event = 'failed' AND (reset_at IS NULL OR seq > reset_at)) AS retry_count FROM e JOIN g USING (export_id, source_id) GROUP BY ALL)
SELECT export_id, 'memory' AS kind, source_id, CASE last WHEN 'reset' THEN 'pending' WHEN 'missing' THEN 'source_missing' ELSE last END AS status, retry_count, n_events, last IN ('reset', 'failed') AND retry_count < 3 AS due FROM f"""
)
def fold_outcomes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    m = F.col("event_id") % 9
    event = F.when(m == 0, "reset").when(m == 1, "missing").when(m == 2, "done").otherwise("failed")
    return status.fold_outcomes(e.select((F.col("user_id") % 8).cast("string").alias("export_id"), F.lit("memory").alias("kind"), F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seq"), event.alias("event")))


@query(sql("SELECT export_id, source_id FROM items WHERE status = 'done' AND k % 5 = 0 OR status IN ('pending', 'failed') AND k % 4 = 0 OR status IN ('source_missing', 'retired', 'excluded') AND k % 4 = 0", "items"))
def record_violations(s: SparkSession, d: str) -> DataFrame:
    k = F.col("source_id").cast("long")
    i = views.items(s, d)
    torn = i.withColumn("checksum", F.when((F.col("status") == "done") & (k % 5 == 0), None).otherwise(F.col("checksum"))).withColumn("output_path", F.when((F.col("status") != "done") & (k % 4 == 0), "/left").otherwise(F.col("output_path")))
    return status.record_violations(torn).select("export_id", "source_id")


# ---- redaction ----


@query(
    """SELECT page_id, 'REDACTED' AS mark, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://redacted.invalid'
  || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE '/REDACTED' END
  || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || array_to_string(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
       lambda p: CASE WHEN string_split(p, '=')[1] IN (@PARAMS) THEN string_split(p, '=')[1] ELSE 'REDACTED' END || CASE WHEN contains(p, '=') THEN '=REDACTED' ELSE '' END), '&') ELSE '' END
  || CASE WHEN regexp_extract(url, '#(.*)', 1) <> '' THEN '#REDACTED' ELSE '' END AS url FROM pages""".replace("@PARAMS", ", ".join(f"'{p}'" for p in redact.KNOWN_PARAMS))
)
def redact_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.lit("REDACTED").alias("mark"), redact.redact_url(F.col("url")).alias("url"))


@query("SELECT doc_id, run, len(run) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{20,}')) AS run FROM documents)")
def alnum_runs(s: SparkSession, d: str) -> DataFrame:
    return redact.alnum_runs(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "run", F.length("run").cast("long").alias("n"))


@query(
    """WITH v AS (SELECT conv_id::VARCHAR AS value, 'conv' AS cls FROM conversations UNION ALL SELECT user_id::VARCHAR, 'user' FROM events), o AS (SELECT value, min(cls) AS cls FROM v WHERE value IS NOT NULL GROUP BY 1)
SELECT value, cls, cls || '_' || row_number() OVER (PARTITION BY cls ORDER BY sha256('s' || chr(31) || 'handle' || chr(31) || value), value) AS handle FROM o"""
)
def handles(s: SparkSession, d: str) -> DataFrame:
    conv = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("value"), F.lit("conv").alias("cls"))
    user = table(s, d, "events").select(F.col("user_id").cast("string").alias("value"), F.lit("user").alias("cls"))
    return redact.handles(conv.unionByName(user), "s")


@query("SELECT export_id, file, '/' || k AS pointer, k AS key, value FROM (SELECT (user_id % 8)::VARCHAR AS export_id, event_id::VARCHAR AS file, props, unnest(json_keys(props)) AS k FROM events) e, LATERAL (SELECT json_extract_string(e.props, '$.\"' || e.k || '\"') AS value)")
def json_leaves(s: SparkSession, d: str) -> DataFrame:
    corpus = table(s, d, "events").select((F.col("user_id") % 8).cast("string").alias("export_id"), F.col("event_id").cast("string").alias("file"), F.col("props").alias("body"))
    return redact.leaves(s, corpus, 3).select("export_id", "file", "pointer", "key", "value")


@query(
    """WITH n AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\p{L}', 'a', 'g'), '[0-9]', '9', 'g'), 'a{12,}', 'aaaaaaaaaaaa', 'g'), '9{12,}', '999999999999', 'g') AS pattern
  FROM (SELECT regexp_replace(url, '^.*/', '') AS name FROM pages)),
shown AS (SELECT pattern, count(*) AS n, list_sort(list_distinct(list(name)))[:3] AS few FROM n GROUP BY 1)
SELECT pattern, n, array_to_string(list_transform(few, lambda f: array_to_string(list_transform(regexp_extract_all(f, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+'),
  lambda t: CASE WHEN lower(t) IN (@WORDS) OR regexp_matches(t, '^[._~-]+$') THEN t ELSE repeat('x', least(len(t), 12)) END), '')), ' ') AS examples FROM shown""".replace("@WORDS", ", ".join(f"'{w}'" for w in (*redact.FILE_WORDS, *redact.EXTENSIONS)))
)
def pattern_census(s: SparkSession, d: str) -> DataFrame:
    out = reports.pattern_census(table(s, d, "pages").select(x.base_name(F.col("url")).alias("name")))
    return out.withColumn("examples", F.array_join("examples", " "))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\S+|\\s'), lambda t: CASE WHEN strlen(t) > 64 OR regexp_matches(t, '[/=%&@]') THEN '<redacted>' ELSE t END), '') AS note FROM documents")
def redact_note(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", x.redact_note(F.col("text"), F.lit(None).cast("string")).alias("note"))


@query("SELECT event_id, strftime(ts + INTERVAL 86400 SECOND, '%Y-%m-%d %H:%M:%S') || ' UTC' AS moved, (epoch_us(ts) // 1000 + 86400000)::VARCHAR AS epoch FROM events")
def shifted_dates(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", redact.shift_date(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), 86_400).alias("moved"), redact.shift_epoch(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), 86_400).alias("epoch"))


# ---- reports ----


@query("SELECT o_custkey, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(*) AS n FROM orders GROUP BY 1")
def year_span(s: SparkSession, d: str) -> DataFrame:
    return reports.year_span(table(s, d, "orders"), "o_custkey", "o_orderdate")


@query(
    """WITH p AS (SELECT l_orderkey::VARCHAR AS id, list_sort(list_distinct(list(l_linenumber::BIGINT + 1))) AS seen FROM lineitem GROUP BY 1)
SELECT id, array_to_string(seen, ',') AS seen, coalesce(array_to_string(list_filter(range(1, list_max(seen) + 1), lambda i: NOT list_contains(seen, i)), ','), '') AS missing FROM p"""
)
def missing_parts(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    number = F.col("l_linenumber").cast("long") + 1
    seen = lambda odd: F.sort_array(F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, number)))
    parts = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(seen(0).alias("zips"), seen(1).alias("folders"))
    out = reports.missing_parts(parts)
    return out.select("id", F.array_join("seen", ",").alias("seen"), F.array_join("missing", ",").alias("missing"))


@query(
    """SELECT (user_id % 8)::VARCHAR AS export_id, 'events' AS section, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT (o_custkey % 16)::VARCHAR, 'orders', count(*) FROM orders GROUP BY 1"""
)
def section_counts(s: SparkSession, d: str) -> DataFrame:
    return reports.section_counts({"events": table(s, d, "events").select((F.col("user_id") % 8).cast("string").alias("export_id")), "orders": table(s, d, "orders").select((F.col("o_custkey") % 16).cast("string").alias("export_id"))})


@query("SELECT event_id, printf('%+010.6f%+011.6f/', value - 50, 50 - value) AS iso, CASE WHEN value < 1024 THEN floor(value)::BIGINT || ' B' ELSE printf('%.1f KiB', floor(value) / 1024) END AS size FROM events")
def formatted_values(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", x.iso6709(F.col("value") - 50, 50 - F.col("value")).alias("iso"), x.binary_bytes(F.floor("value")).alias("size"))


# ---- more of status and planning ----


@query(
    sql(
        f"""SELECT export_id, source_id, CASE WHEN bytes % 2 = 0 OR status = 'pending' THEN 'excluded' ELSE status END AS status, CASE WHEN bytes % 2 = 0 OR status = 'pending' THEN '{status.EXCLUDED_NOTE}' ELSE last_error END AS last_error,
  CASE WHEN bytes % 2 = 0 OR status = 'pending' THEN {NOW} ELSE updated_at END AS updated_at, checksum FROM items""",
        "items",
    )
)
def exclude(s: SparkSession, d: str) -> DataFrame:
    i = views.items(s, d)
    out = status.exclude(i, i.filter("bytes % 2 = 0 or status = 'pending'").select(*status.KEY), NOW)
    return out.select("export_id", "source_id", "status", "last_error", "updated_at", "checksum")


@query(
    sql(
        """SELECT export_id, kind, source_id, status, output_path FROM items UNION ALL
SELECT (c_custkey % 16)::VARCHAR, 'history_export', c_custkey::VARCHAR, 'claimed', '/out/' || c_name FROM customer""",
        "items",
    )
)
def claim_directories(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    facts = c.select((F.col("c_custkey") % 16).cast("string").alias("export_id"), F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("/out/"), "c_name").alias("directory"))
    return status.claim_directories(views.items(s, d), facts, NOW).select("export_id", "kind", "source_id", "status", "output_path")


@query(sql("SELECT e.export_id, entry_index::VARCHAR AS source_id, coalesce(status, 'pending') AS status FROM entries e LEFT JOIN items i ON e.export_id = i.export_id AND e.entry_index::VARCHAR = i.source_id", "entries", "items"))
def status_overlay(s: SparkSession, d: str) -> DataFrame:
    rows = views.entries(s, d).select("export_id", F.col("entry_index").cast("string").alias("source_id"))
    return plan.status_overlay(rows, views.items(s, d), "memory")


@query(
    sql(
        """SELECT export_id, count(*) FILTER (status = 'pending') AS fixed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS skipped, 0::BIGINT AS deferred, 0::BIGINT AS excluded FROM items GROUP BY 1""",
        "items",
    )
)
def run_report(s: SparkSession, d: str) -> DataFrame:
    before = views.items(s, d)
    facts = before.filter("status = 'pending'").select(*status.KEY, F.concat(F.lit("/out/"), "source_id").alias("output_path"), F.sha2("source_id", 256).alias("checksum"), F.lit(1).cast("long").alias("bytes"))
    rows = before.select("export_id", "source_id", F.lit("planned").alias("disposition"))
    return reports.run_report(rows, before, status.mark_done(before, facts, NOW))


_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


@query(
    sql(
        "SELECT export_id, uuid, day, " + _UUID.format("uuid") + " AS id, CASE WHEN kind = 'image' THEN 'main' ELSE 'overlay' END AS role, CASE WHEN kind = 'image' THEN 'image' ELSE 'video' END AS kind, CASE WHEN kind = 'image' THEN 'jpg' ELSE 'mp4' END AS out_ext FROM media",
        "media",
    )
)
def memory_names(s: SparkSession, d: str) -> DataFrame:
    m = views.media(s, d)
    image = F.col("kind") == "image"
    name = F.concat(F.lit("x/memories/"), "day", F.lit("_"), F.concat_ws("-", *(F.substring("uuid", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.when(image, "-main.JPEG").otherwise("-overlay.Mp4"))
    p = m.select("export_id", "uuid", x.parse_memory_name(name).alias("p"))
    return p.select("export_id", "uuid", "p.day", F.col("p.uuid").alias("id"), "p.role", x.kind_of_ext(F.col("p.extension")).alias("kind"), x.output_ext(F.col("p.extension")).alias("out_ext"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 12:34:56 UTC' AS stamp, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS previous_day,
  '/out/' || strftime(o_orderdate, '%Y/%m') || '/' || strftime(o_orderdate, '%Y%m%d') || '_123456_2.jpg' AS path FROM orders"""
)
def stamps_and_names(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("t", x.parse_utc(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:34:56 UTC"))))
    moment = x.to_moment(F.col("t"))
    near = x.neighbours(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", x.stamp_text(F.col("t")).alias("stamp"), near[0].alias("next_day"), near[1].alias("previous_day"), F.concat_ws("/", x.output_dir(F.lit("/out"), moment), x.output_name(x.output_stem(moment), F.lit("jpg"), F.lit(1))).alias("path"))


_FINE = ", ".join(f"'{w}'" for w in (*redact.FILE_WORDS, *redact.EXTENSIONS, *redact.ENUM_WORDS, "redacted", "latitude", "longitude", "invalid"))


@query(
    f"""SELECT doc_id, token, 'token' AS rule FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}|[0-9]+')) AS token FROM documents) t
WHERE regexp_matches(token, '^[A-Za-z]') AND lower(token) NOT IN (SELECT lower(w) FROM (SELECT unnest([{_FINE}]) AS w))
  AND NOT regexp_matches(token, '^(x+|0+)$') AND token NOT IN (SELECT p_name FROM part)"""
)
def leaked_words(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("/text").alias("pointer"), F.lit("string").alias("kind"), F.col("text").alias("value"))
    tokens = redact.strange_tokens(docs, table(s, d, "part").select(F.col("p_name").alias("token")))
    return tokens.filter("rule = 'token'").select(F.col("file").cast("long").alias("doc_id"), "token", "rule")


_PLAIN_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://redacted\.invalid(/(REDACTED)?)*(\?{0}(&{0})*)?(#(REDACTED)?)?$".format(f"(REDACTED|({'|'.join(redact.KNOWN_PARAMS)}|REDACTED)=REDACTED)?")


@query(
    rf"""WITH f AS (SELECT doc_id, 'long_run' AS rule, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{32,}}')) AS t FROM documents
UNION ALL SELECT doc_id, 'live_url', t FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{redact.URL_IN_TEXT.replace("'", "''")}')), '[.,);]+$', '') AS t FROM documents) WHERE NOT regexp_matches(t, '{_PLAIN_URL}')
UNION ALL SELECT doc_id, 'coordinate', t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{redact.PAIR_IN_TEXT}')) AS t FROM documents)
  WHERE NOT (regexp_extract(t, '([+-]?[0-9]+(\.[0-9]+)?)\s*,[^,]*$', 1)::DOUBLE BETWEEN 1 - 1e-9 AND 2 + 1e-9 AND regexp_extract(t, ',\s*([^,\s]*)$', 1)::DOUBLE BETWEEN 1 - 1e-9 AND 2 + 1e-9)
UNION ALL SELECT doc_id, CASE WHEN regexp_matches(t, '^[0-9]') THEN 'number' ELSE 'token' END, t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}|[0-9]+')) AS t FROM documents)
  WHERE lower(t) NOT IN (SELECT lower(w) FROM (SELECT unnest([{_FINE}]) AS w))
  AND NOT regexp_matches(t, '^(x+|0+)$') AND t NOT IN (SELECT p_name FROM part))
SELECT doc_id::VARCHAR AS file, '/text' AS pointer, rule, len(t) AS n_chars FROM f"""
)
def leak_check(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit("/text").alias("pointer"), F.lit("string").alias("kind"), F.col("text").alias("value"))
    return redact.leak_check(docs, table(s, d, "part").select(F.col("p_name").alias("token"))).drop("excerpt")


from heronry.plans import corpora, deliveries, rules  # noqa: E402,F401
