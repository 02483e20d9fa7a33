"""Queries of redaction and its audit over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import expr as x
from heronry.operators import reconcile, redact, reports
from heronry.plans import views
from heronry.plans.registry import query
from heronry.plans.rules import _pick
from heronry.plans.views import sql
from heronry.sources.tables import dealt, table


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def event_corpus(s: SparkSession, d: str) -> DataFrame:
    """Events as one JSON document each: a whole number, a time, a word, a decimal number and JSON in a text."""
    body = F.to_json(F.struct(F.col("user_id").alias("username"), _text("ts").alias("created"), "event_type", F.col("value").alias("amount"), F.lit(0).alias("zero"), F.lit("").alias("none"), "props"))
    return dealt(table(s, d, "events"), "event_id").select((F.col("user_id") % 8).cast("string").alias("export_id"), _text("event_id").alias("file"), body.alias("body"))


_DIGEST = "sha256('s' || chr(31) || 'leaf' || chr(31) || event_id || chr(31) || '/{}')"
def _stand_in(v: str) -> str:
    """redact.stand_in_number with seed s in SQL: a number of len(v) digits as a pair, each half moved by what the other draws."""
    right = f"(10 ** ((len({v}) - 1) // 2))::HUGEINT"
    left = f"(CASE WHEN len({v}) = 1 THEN 10 ELSE 9 * 10 ** (len({v}) - 1 - (len({v}) - 1) // 2) END)::HUGEINT"
    low = f"(CASE WHEN len({v}) = 1 THEN 0 ELSE 10 ** (len({v}) - 1) END)::HUGEINT"
    drawn = lambda i, half: f"('0x' || sha256('s' || chr(31) || 'number' || chr(31) || {i} || chr(31) || len({v}) || chr(31) || {half})[1:13])::BIGINT"
    start = f"{{'l': ({v}::HUGEINT - {low}) // {right}, 'r': ({v}::HUGEINT - {low}) % {right}}}"
    step = f"CASE WHEN i % 2 = 0 THEN {{'l': (p.l + {drawn('i', 'p.r')}) % {left}, 'r': p.r}} ELSE {{'l': p.l, 'r': (p.r + {drawn('i', 'p.l')}) % {right}}} END"
    for i in range(4):
        start = f"list_transform([{start}], lambda p: {step.replace('i % 2', f'{i} % 2').replace('|| i ||', f'|| {i} ||')})[1]"
    return f"list_transform([{start}], lambda p: ({low} + p.l * {right} + p.r)::VARCHAR)[1]"


_NUMBER = "greatest(translate({0}[1:1], 'abcdef', '123456'), '1') || translate({0}[2:{1}], 'abcdef', '123456')"


@query(
    f"""WITH e AS (SELECT event_id, user_id, ts, event_type, props, value::VARCHAR AS v, {_DIGEST.format("event_type")} AS dt, {_DIGEST.format("amount")} AS da, {_DIGEST.format("props")} AS dp,
  rtrim(strftime(ts, '%f'), '0') AS f FROM events),
n AS (SELECT *, string_split(v, '.')[1] AS whole, nullif(string_split(v, '.')[2], '0') AS decimals FROM e)
SELECT event_id::VARCHAR AS file, '/username' AS pointer, 'int' AS kind, 'join int' AS cls, {_stand_in("user_id::VARCHAR")} AS out FROM e
UNION ALL SELECT event_id::VARCHAR, '/created', 'string', 'datetime', strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') || CASE WHEN f = '' THEN '' ELSE '.' || translate(f, '0123456789', '9876543210') END FROM e
UNION ALL SELECT event_id::VARCHAR, '/event_type', 'string', 'generic', 'redacted-' || translate(dt, '0123456789', 'ghijklmnop')[1:6] FROM e
UNION ALL SELECT event_id::VARCHAR, '/amount', 'float', 'float', CASE WHEN whole = '0' THEN '0' ELSE {_NUMBER.format("da", "len(whole)")} END || CASE WHEN decimals IS NULL THEN '' ELSE '.' || translate(reverse(da)[1:len(decimals)], 'abcdef', '012345') END FROM n
UNION ALL SELECT event_id::VARCHAR, '/zero', 'int', 'int', '0' FROM e UNION ALL SELECT event_id::VARCHAR, '/none', 'string', 'empty', '' FROM e
UNION ALL SELECT event_id::VARCHAR, '/props', 'string', 'generic', 'redacted-' || translate(dp, '0123456789', 'ghijklmnop')[1:6] FROM e"""
)
def redacted_leaves(s: SparkSession, d: str) -> DataFrame:
    return redact.synthesise(redact.leaves(s, event_corpus(s, d), 1), "s", 86_400).select("file", "pointer", "kind", "cls", "out")


@query("SELECT event_id::VARCHAR AS file, '{\"' || user_id || '\":{\"12\":{},\"7\":\"x\",\"k' || event_id || '\":0},\"a\":[' || user_id || ',{\"b\":\"' || event_type || '\"},null],\"o\":{\"0\":true},\"z\":[]}' AS body FROM events")
def renested(s: SparkSession, d: str) -> DataFrame:
    """Documents taken apart into leaves and put together again; some of their objects have numbers as keys."""
    e = table(s, d, "events")
    numbers = F.concat(F.lit(', "'), _text("user_id"), F.lit('": {"7": "x", "12": {}, "k'), _text("event_id"), F.lit('": 0}'))
    body = F.concat(F.lit('{"z": [], "o": {"0": true}, "a": ['), _text("user_id"), F.lit(', {"b": "'), "event_type", F.lit('"}, null]'), numbers, F.lit("}"))
    corpus = e.select(F.lit("e").alias("export_id"), _text("event_id").alias("file"), body.alias("body"))
    return redact.renest(redact.leaves(s, corpus, 3), "value").select("file", "body")


@query("SELECT event_id::VARCHAR AS file FROM events WHERE event_id % 4 = 0")
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    body = _pick(n, F.concat(F.lit('{"k": 1, "k": '), _text("user_id"), F.lit("}")), F.col("props"), F.concat("props", F.lit("}")), F.lit("7"))
    return redact.duplicate_keys(table(s, d, "events").select(F.lit("e").alias("export_id"), _text("event_id").alias("file"), body.alias("body"))).select("file")


_HANDLE = "'{0}_' || row_number() OVER (ORDER BY sha256('s' || chr(31) || 'handle' || chr(31) || {1}), {1})"


@query(
    f"""WITH h AS (SELECT c_name, {_HANDLE.format("user", "c_name")} AS handle FROM (SELECT DISTINCT c_name FROM customer)), k AS (SELECT o, {_HANDLE.format("key", "o")} AS handle FROM (SELECT DISTINCT o_orderpriority AS o FROM orders))
SELECT 'chat' AS kind, c_custkey AS id, '{{"Received Saved Chat History":[],"' || handle || '":[{{"From":"' || handle || '","n":0}},0]}}' AS body FROM customer JOIN h USING (c_name)
UNION ALL SELECT 'order', o_orderkey, '{{"by":{{"' || handle || '":{{"Saved Media":""}}}}}}' FROM orders JOIN k ON o = o_orderpriority"""
)
def masked_keys(s: SparkSession, d: str) -> DataFrame:
    """Documents whose keys are names, by a built-in rule and by one of the user's, redacted and put together again."""
    people, orders = dealt(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey"), dealt(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    chat = F.concat(F.lit('{"'), "c_name", F.lit('": [{"n": 0, "From": "'), "c_name", F.lit('"}, 0], "Received Saved Chat History": []}'))
    order = F.concat(F.lit('{"by": {"'), "o_orderpriority", F.lit('": {"Saved Media": ""}}}'))
    corpus = people.select(F.concat(F.lit("c"), _text("c_custkey")).alias("export_id"), F.lit("chat_history.json").alias("file"), chat.alias("body"))
    corpus = corpus.unionByName(orders.select(F.concat(F.lit("o"), _text("o_orderkey")).alias("export_id"), F.lit("orders.json").alias("file"), order.alias("body")))
    rules = (*redact.BUILTIN_RULES, redact.MaskRule("order*.json:/by"))
    rows = redact.leaves(s, corpus, rules=rules)
    redact.require_used(rows, rules)
    out = redact.renest(redact.synthesise(rows, "s", 0))
    return out.select(F.when(F.left("export_id", F.lit(1)) == "c", "chat").otherwise("order").alias("kind"), F.substring("export_id", 2, 20).cast("long").alias("id"), "body")


@query("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def joined_ids(s: SparkSession, d: str) -> DataFrame:
    """Two redacted tables of documents, joined on the stand-ins of a uuid and of a whole number that they share."""
    h = lambda c: F.md5(_text(c))
    uuid = lambda c: F.concat_ws("-", *(F.substring(h(c), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    one = dealt(table(s, d, "customer").select("c_custkey"), "c_custkey").select(F.lit("c").alias("export_id"), _text("c_custkey").alias("file"), F.to_json(F.struct(uuid("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"))).alias("body"))
    two = dealt(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.lit("o").alias("export_id"), _text("o_orderkey").alias("file"), F.to_json(F.struct(F.array(F.struct(uuid("o_custkey").alias("Media ID"), F.col("o_custkey").alias("Sender"))).alias("list"))).alias("body"))
    rows = redact.synthesise(redact.leaves(s, one.unionByName(two)), "s", 0)
    ids = rows.groupBy("export_id", "file").agg(F.max(F.when(F.col("cls") == "join", F.col("out"))).alias("uuid"), F.max(F.when(F.col("cls") == "join int", F.col("out"))).alias("number"))
    left, right = (ids.filter(F.col("export_id") == e).select("file", "uuid", "number") for e in ("c", "o"))
    return left.join(right.drop("file"), ["uuid", "number"]).groupBy(F.col("file").cast("long").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


_VALUES = """(SELECT o_orderkey AS k, o_orderkey % 13 AS n, CASE o_orderkey % 3 WHEN 0 THEN 'Some Key' WHEN 1 THEN 'Conversation-ID' ELSE 'Note' END AS key FROM orders)"""
_FORMATS = "n IN (1, 2, 3)"


@query(
    f"""SELECT k, CASE WHEN n = 0 THEN 'empty' WHEN key = 'Conversation-ID' AND NOT {_FORMATS} THEN 'join' WHEN n = 5 AND key <> 'Note' THEN 'enum' WHEN n = 1 THEN 'url' WHEN n = 2 THEN 'latlon' WHEN n = 3 THEN 'datetime' WHEN n = 4 THEN 'uuid'
  WHEN n = 6 THEN 'extension' WHEN n = 7 THEN 'filename' WHEN n = 8 THEN 'digits' ELSE 'generic' END AS cls, CASE WHEN key = 'Conversation-ID' THEN 'conv' END AS join_class FROM {_VALUES}"""
)
def value_classes(s: SparkSession, d: str) -> DataFrame:
    """One text of every format, with a digest of its row where the format has room, under three kinds of keys."""
    k, h = F.col("o_orderkey"), F.md5(_text("o_orderkey"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    value = _pick(
        k % 13, F.lit(""), F.concat(F.lit("https://h/"), h), F.concat(F.lit("Latitude, Longitude: 1.5, 9."), _text("o_orderkey")), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), uuid,
        F.lit("MEDIA"), F.lit(".JPG"), F.concat(h, F.lit(".png")), F.concat(F.lit("00"), _text("o_orderkey")), F.concat(F.lit("some words "), h), F.lit("media"), F.concat(h, F.lit(".exe")), F.concat(F.lit("a/"), h, F.lit(".png")),
    )
    key = _pick(k % 3, F.lit("Some Key"), F.lit("Conversation-ID"), F.lit("Note"))
    return table(s, d, "orders").select(k.alias("k"), redact.value_class(value, key).alias("cls"), redact.join_class(key).alias("join_class"))


@query(
    """SELECT c_custkey, 'lat, lon: 1.' || translate(md5(c_custkey::VARCHAR)[1:2], 'abcdef', '012345') || ', 1.' || translate(reverse(md5(c_custkey::VARCHAR))[1:1], 'abcdef', '012345') AS pair, '1.' || translate(md5(c_custkey::VARCHAR)[1:3], 'abcdef', '012345') AS number,
  c_custkey % 2 = 0 AS by_key FROM customer"""
)
def redacted_places(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    digest = F.md5(_text("c_custkey"))
    pair = F.concat(F.lit("lat, lon: -"), _text("c_nationkey"), F.lit(".25, "), F.lpad(_text("c_custkey"), 3, "0"), F.lit(".5"))
    key = F.when(F.col("c_custkey") % 2 == 0, "Lat").otherwise("late")
    return c.select("c_custkey", redact.redact_latlon(pair, digest).alias("pair"), redact.fake_coordinate(F.concat(F.lit("-"), _text("c_custkey"), F.lit(".125")), digest).alias("number"), redact.is_coordinate(key, F.lit("place")).alias("by_key"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, 'xxx_' || repeat('x', least(12, len(l_orderkey::VARCHAR))) || '-main' || strftime(l_shipdate + INTERVAL 1 DAY, '%Y-%m-%d') || '~00000000-0000-0000-0000-000000000000.jpg' AS name FROM lineitem"""
)
def redacted_names(s: SparkSession, d: str) -> DataFrame:
    h = F.md5(_text("l_orderkey"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    name = F.concat(F.lit("IMG_"), _text("l_orderkey"), F.lit("-main"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("~"), uuid, F.lit(".jpg"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", redact.redact_filename(name, 86_400).alias("name"))


@query(
    """SELECT o_custkey::VARCHAR AS export_id, 'f' || o_orderkey || '.json' AS file, repeat('x', len('f')) || repeat('x', len(o_orderkey::VARCHAR)) || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.json' AS mirror
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, len(o_orderkey::VARCHAR) ORDER BY 'f' || o_orderkey || '.json') AS k FROM orders)"""
)
def mirrored_names(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "orders").select(_text("o_custkey").alias("export_id"), F.concat(F.lit("f"), _text("o_orderkey"), F.lit(".json")).alias("file"))
    return redact.mirrored_names(files)


@query("SELECT page_id, CASE WHEN len(t) <= 80 THEN t ELSE t[:80] || '...' END AS excerpt FROM (SELECT page_id, regexp_replace(url, '[A-Za-z0-9_]', '*', 'g') || '/REDACTED' AS t FROM pages)")
def masked_excerpts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", redact.masked_excerpt(F.concat("url", F.lit("/REDACTED"))).alias("excerpt"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, 'r1' AS rule FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 'r2' FROM lineitem WHERE l_linenumber % 2 = 1 AND l_suppkey = 3
UNION ALL SELECT NULL, NULL, NULL, 'r3'"""
)
def masking_rules(s: SparkSession, d: str) -> DataFrame:
    """Leaves that rules meet, and the rule that meets none."""
    li = table(s, d, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    rows = li.select("l_orderkey", "l_linenumber", "l_suppkey", F.when(even, F.concat(F.lit("a"), _text("l_orderkey"), F.lit(".json"))).otherwise("b.json").alias("file"), F.when(even, F.concat(F.lit("/x/"), _text("l_suppkey"), F.lit("/y"))).otherwise(F.concat(F.lit("/x/"), _text("l_suppkey"))).alias("pointer"))
    rules = s.createDataFrame([("r1", "a*.json", "/x/*/y"), ("r2", "b.json", "/x/3"), ("r3", "*", "/x/*/z")], "rule string, file_glob string, pointer string")
    met, unused = redact.rule_hits(rows, rules)
    return met.select("l_orderkey", "l_linenumber", "l_suppkey", "rule").unionByName(unused.select("rule"), allowMissingColumns=True)


_ENDINGS = ", ".join(f"'{e}'" for e in redact.EXTENSIONS)
_GAPS = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z][A-Za-z0-9]*|[0-9]+|[^A-Za-z0-9]+)"


@query(
    rf"""WITH p AS (SELECT CASE WHEN page_id % 2 = 0 THEN replace(url, '/', '_') ELSE url END AS path FROM pages), t AS (SELECT contains(path, '/') AS nested, unnest(regexp_extract_all(path, '{_GAPS}')) AS t FROM p),
b AS (SELECT t, CASE WHEN lower(t) IN ('http', 'https', 'www', {_ENDINGS}) OR regexp_matches(t, '^[._~/-]+$') THEN NULL WHEN nested THEN CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*$') THEN 'withheld' END
  WHEN NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*$') THEN 'not_fixable' WHEN len(t) > 12 THEN 'over_cap' ELSE 'named' END AS bucket FROM t)
SELECT bucket, CASE WHEN bucket = 'named' THEN lower(t) END AS word, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY ALL"""
)
def vocabulary_gaps(s: SparkSession, d: str) -> DataFrame:
    paths = table(s, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("_"))).otherwise(F.col("url")).alias("path"))
    return redact.vocabulary_gaps(paths, ("http", "https", "www"))


@query(
    """SELECT file, kind, cls, count(*) AS n FROM (SELECT event_id % 10 AS file, unnest([{'kind': 'int', 'cls': 'int'}, {'kind': 'string', 'cls': 'datetime'}, {'kind': 'string', 'cls': 'generic'}, {'kind': 'float', 'cls': 'float'},
  {'kind': 'int', 'cls': 'int'}, {'kind': 'string', 'cls': 'empty'}, {'kind': 'string', 'cls': 'generic'}], recursive := true) FROM events) GROUP BY ALL"""
)
def redaction_tallies(s: SparkSession, d: str) -> DataFrame:
    rows = redact.leaves(s, event_corpus(s, d), 1)
    rows = rows.withColumn("cls", F.when(F.col("kind") == "string", redact.value_class(F.col("value"), F.col("key"))).otherwise(F.col("kind")))
    return redact.tallies(rows.withColumn("file", F.col("file").cast("long") % 10))


@query(
    """WITH g AS (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey, o_orderpriority)
SELECT 'orders' || c_nationkey || '.json' AS file, count(*) AS arrays, count(*) FILTER (n > 2) AS truncated, sum(greatest(n - 2, 0))::BIGINT AS left_out, count(*) AS masked, count(*) AS kept FROM g GROUP BY 1"""
)
def redaction_statistics(s: SparkSession, d: str) -> DataFrame:
    """Arrays that a sample of two elements cuts, keys that a rule masks and labels that it keeps, of one document for each
    customer and priority."""
    orders = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    docs = orders.groupBy("c_nationkey", "o_custkey", "o_orderpriority").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("keys"))
    body = F.concat(F.lit('{"by": {"'), "o_orderpriority", F.lit('": {"Saved Media": '), "keys", F.lit("}}}"))
    corpus = docs.select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("export_id"), F.concat(F.lit("orders"), _text("c_nationkey"), F.lit(".json")).alias("file"), body.alias("body"))
    rows = redact.leaves(s, corpus, rules=(*redact.BUILTIN_RULES, redact.MaskRule("orders*.json:/by")))
    return redact.array_tallies(rows, 2).join(redact.key_tallies(rows), "file")


@query("SELECT 'media' AS word, count(*) AS n FROM events WHERE event_type = 'view' HAVING count(*) > 0 UNION ALL SELECT 'jpg', count(*) FROM events HAVING count(*) > 0")
def vocabulary_used(s: SparkSession, d: str) -> DataFrame:
    """Words of the closed vocabularies that a redacted corpus kept: an enum's word in some documents, an extension in all."""
    kind = F.when(F.col("event_type") == "view", "MEDIA").otherwise(F.concat(F.lit("some words of "), "event_type"))
    body = F.to_json(F.struct(kind.alias("Some Kind"), F.concat(_text("event_id"), F.lit("-q.JPG")).alias("Some Name")))
    corpus = table(s, d, "events").select(F.lit("e").alias("export_id"), _text("event_id").alias("file"), body.alias("body"))
    return redact.vocabulary_used(redact.synthesise(redact.leaves(s, corpus), "s", 0), (*redact.ENUM_WORDS, *redact.FILE_WORDS, *redact.EXTENSIONS))


@query(
    """WITH k AS (SELECT o_custkey AS container, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey::VARCHAR ELSE o_orderpriority END AS key, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus ELSE 'string' END AS kind FROM orders),
h AS (SELECT key, count(DISTINCT container) AS homes FROM k GROUP BY 1)
SELECT container, count(*) AS n FROM k JOIN h USING (key) GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT kind) = 1 AND count(*) FILTER (key <> '1-URGENT') > 0 AND 2 * count(*) FILTER (homes = 1 AND key <> '1-URGENT') >= count(*) FILTER (key <> '1-URGENT')"""
)
def id_keyed_containers(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "orders").select(F.col("o_custkey").alias("container"), F.when(F.col("o_custkey") % 3 == 0, _text("o_orderkey")).otherwise(F.col("o_orderpriority")).alias("key"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus")).otherwise("string").alias("kind"))
    return redact.id_keyed_containers(keys, ("1-URGENT",)).select("container", "n")


@query(
    """SELECT pattern, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '\\p{L}', 'a', 'g'), '[0-9]', '9', 'g'), 'a{12,}', 'aaaaaaaaaaaa', 'g'), '9{12,}', '999999999999', 'g') || '-' || c_nationkey AS pattern FROM customer) GROUP BY 1 ORDER BY n DESC, pattern LIMIT 7"""
)
def top_patterns(s: SparkSession, d: str) -> DataFrame:
    """The seven most frequent patterns."""
    census = table(s, d, "customer").select(F.concat(reports.mask_name(F.col("c_name")), F.lit("-"), _text("c_nationkey")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return reports.top_patterns(census, 7)


@query("SELECT page_id, url AS path FROM pages WHERE page_id % 2 = 0")
def unparsed_names(s: SparkSession, d: str) -> DataFrame:
    """Names in a listing that no grammar reads."""
    p = table(s, d, "pages")
    h = F.md5(_text("page_id"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("m/2020-01-02_"), uuid, F.lit("-main.jpg")))
    listing = p.select(_text("page_id").alias("export_id"), path.alias("path"))
    return reconcile.memory_media(listing)[1].select(F.col("export_id").cast("long").alias("page_id"), "path")


@query(sql("SELECT export_id, uuid, 'place ' || entry_index AS place FROM pairs", "entries", "media", "pairs"))
def matched_places(s: SparkSession, d: str) -> DataFrame:
    """Place names that come with the entry that a medium is paired with."""
    entries = views.entries(s, d).withColumn("place", F.concat(F.lit("place "), _text("entry_index")))
    pairs, _, _ = reconcile.bucket_match(entries, views.media(s, d))
    return pairs.select("export_id", "media.uuid", "entry.place")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END AS day, lower(event_type) AS folded FROM events")
def folded_days(s: SparkSession, d: str) -> DataFrame:
    """Days in their range, one further on; words without regard to case."""
    e = table(s, d, "events")
    day = x.day_of(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-32")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select("event_id", x.neighbours(day)[0].alias("day"), x.fold(F.upper("event_type")).alias("folded"))
