"""Queries of deliveries: JSON sections built from the driver's tables, their typed rows, and reports over them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators import plan, reports, status, timeline
from heronry.plans import views
from heronry.plans.registry import ORACLE_SQL, query
from heronry.plans.views import sql
from heronry.sources import exports
from heronry.sources.named_files import land, read_landed
from heronry.sources.tables import cut, dealt, shared_dir, table
from heronry.streaming import jobs


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _stamp(c: str) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def _named(**fields: Column) -> Column:
    """A struct whose fields have the names of ``KEYS``."""
    return F.struct(*(v.alias(KEYS.get(k, k)) for k, v in fields.items()))


#: Keys of the archives' JSON files, which are no names of Python.
KEYS = {
    "sender": "From", "media_type": "Media Type", "created": "Created", "content": "Content", "title": "Conversation Title", "is_sender": "IsSender", "epoch": "Created(microseconds)", "is_saved": "IsSaved", "media_ids": "Media IDs",
    "date": "Date", "location": "Location", "link": "Download Link", "direct": "Media Download Url", "username": "Username", "display_name": "Display Name", "creation": "Creation Timestamp", "modified": "Last Modified Timestamp", "source": "Source",
}


def _texts(rows: DataFrame, file: str, body: Column) -> DataFrame:
    return rows.select("export_id", F.lit(file).alias("file"), F.to_json(body).alias("body"))


def chat_texts(s: SparkSession, d: str) -> DataFrame:
    """Every conversation is the chat history of an export of its own; a tenth can't be parsed, a tenth is no object."""
    c = table(s, d, "conversations")
    turn = F.col("turn")
    message = _named(
        sender=F.col("role"), media_type=F.when(turn % 2 == 0, "Text").otherwise("note"), created=F.when(turn % 7 == 0, "yesterday").otherwise(F.format_string("2020-02-30 %02d:%02d:00 UTC", (turn % 24).cast("int"), (turn % 60).cast("int"))),
        content=F.col("text"), title=F.when(turn == 1, "").otherwise(F.lit("t")), is_sender=F.col("role") == "user", epoch=turn % 3, is_saved=turn % 2 == 1, media_ids=F.concat(F.lit("b~"), _text("turn")),
    )
    rows = c.groupBy(_text("conv_id").alias("export_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda r: r["m"]).alias("rows"))
    texts = _texts(rows, "chat_history.json", F.create_map(F.concat(F.lit("c"), "export_id"), F.col("rows")))
    k = F.col("export_id").cast("long") % 10
    return texts.withColumn("body", F.when(k == 8, F.concat(F.lit("["), "body", F.lit("]"))).when(k == 9, F.concat("body", F.lit("}"))).otherwise(F.col("body")))


_CHAT = "conversations WHERE conv_id % 10 < 8"


@query(
    """SELECT conv_id::VARCHAR AS export_id, file, CASE WHEN file <> 'chat_history.json' THEN 'absent' WHEN conv_id % 10 > 7 THEN 'broken' ELSE 'loaded' END AS state
FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([{}]) AS file)""".format(", ".join(f"'{f}'" for f in exports.SECTION_FILES))
)
def section_states(s: SparkSession, d: str) -> DataFrame:
    return exports.read_sections(chat_texts(s, d))[0].select("export_id", "file", "state")


@query("SELECT DISTINCT conv_id::VARCHAR AS export_id, 'chat_history.json' AS file, CASE WHEN conv_id % 10 = 8 THEN 'shape' ELSE 'syntax' END AS kind FROM conversations WHERE conv_id % 10 > 7")
def section_errors(s: SparkSession, d: str) -> DataFrame:
    return exports.read_sections(chat_texts(s, d))[1].select("export_id", "file", "kind")


def misshapen_texts(s: SparkSession, d: str) -> DataFrame:
    """Orders as files, of which some are right and the others have each another shape than theirs somewhere."""
    o, k = dealt(table(s, d, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey")
    bodies = [
        ("memories_history.json", '{"Saved Media": "@"}'), ("chat_history.json", '{"@": [7, {"From": "@"}]}'), ("chat_history.json", '{"@": {"From": "@"}}'), ("story_history.json", '{"Your Story Views": [{"Story Views": null}, {"Story Views": -1}, {"Story Date": 3}]}'),
        ("chat_history.json", '{"@": [{"Created(microseconds)": "@", "IsSender": "no"}, {"IsSender": 1}]}'), ("user_profile.json", '{"Interactions": {"Web Interactions": ["a"], "App Interactions": [{"App": "@", "Count": 2}, 7]}, "New": [1]}'),
        ("chat_history.json", '{"@": [{"Content": null, "Created(microseconds)": null, "Conversation Title": null, "IsSender": true}]}'), ("snapchat_plus.json", '{"": [{"Price": 3}, {"Price": 2.5}]}'), ("ranking.json", "[1]"),
    ]
    pick = lambda i: F.element_at(F.array(*(F.lit(b[i]) for b in bodies)), (k % len(bodies) + 1).cast("int"))
    return o.select(_text("o_orderkey").alias("export_id"), pick(0).alias("file"), F.replace(pick(1), F.lit("@"), _text("o_orderkey")).alias("body"))


@query(
    """SELECT o_orderkey::VARCHAR AS export_id, file, path, expected, found, n::BIGINT AS n FROM orders JOIN (VALUES (0, 'memories_history.json', '/Saved Media', 'array', 'string', 1), (1, 'chat_history.json', '/*/*', 'object', 'int', 1),
  (2, 'chat_history.json', '/*', 'array', 'object', 1), (3, 'story_history.json', '/Your Story Views/*/Story Views', 'count', 'null', 1), (3, 'story_history.json', '/Your Story Views/*/Story Views', 'count', 'int', 1),
  (3, 'story_history.json', '/Your Story Views/*/Story Date', 'string', 'int', 1), (4, 'chat_history.json', '/*/*/Created(microseconds)', 'int', 'string', 1), (4, 'chat_history.json', '/*/*/IsSender', 'bool', 'string', 1),
  (4, 'chat_history.json', '/*/*/IsSender', 'bool', 'int', 1)) t(k, file, path, expected, found, n) ON o_orderkey % 9 = k"""
)
def shape_errors(s: SparkSession, d: str) -> DataFrame:
    return exports.shape_errors(misshapen_texts(s, d))


@query("SELECT o_orderkey::VARCHAR AS export_id, CASE WHEN o_orderkey % 9 IN (5, 6, 7) THEN 'loaded' ELSE 'broken' END AS state FROM orders")
def shape_states(s: SparkSession, d: str) -> DataFrame:
    """States of files that are JSON, some of another shape than theirs."""
    return exports.read_sections(misshapen_texts(s, d))[0].filter("state <> 'absent'").select("export_id", "state")


@query(
    f"""SELECT conv_id::VARCHAR AS export_id, 'c' || conv_id AS conversation, 'chat' AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS sender, CASE WHEN turn % 2 = 0 THEN 'TEXT' ELSE 'NOTE' END AS media_type,
  CASE WHEN turn % 7 > 0 THEN printf('2020-02-30 %02d:%02d:00 UTC', turn % 24, turn % 60) END AS created, nullif(turn % 3, 0) AS epoch, nullif(text, '') AS content, CASE WHEN turn <> 1 THEN 't' END AS title, role = 'user' AS is_sender, turn % 2 = 1 AS is_saved,
  'b~' || turn AS media_ids, CASE WHEN turn % 7 = 0 THEN 9 END AS wrong FROM {_CHAT}"""
)
def chat_messages(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    m = exports.chat_messages(exports.read_sections(chat_texts(s, d))[0])
    return m.select("export_id", "conversation", "source", "pos", "sender", "media_type", x.stamp_text(F.col("created")).alias("created"), F.col("created_epoch_ms").alias("epoch"), "content", "title", "is_sender", "is_saved", "media_ids", F.col("error.n_chars").alias("wrong"))


@query(f"SELECT conv_id::VARCHAR AS export_id, 'chat_history.json' AS file, 'Created' AS field, 'timestamp' AS kind, 9 AS n_chars FROM {_CHAT} AND turn % 7 = 0")
def table_errors(s: SparkSession, d: str) -> DataFrame:
    return exports.table_errors(exports.chat_messages(exports.read_sections(chat_texts(s, d))[0]))


@query(
    """SELECT user_id::VARCHAR AS export_id, event_type AS conversation, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, CASE WHEN event_id % 4 > 0 THEN 'u' || event_id % 5 END AS sender,
  event_id % 2 = 0 AS is_sender, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS created, nullif(event_id, 0) AS epoch, NULL AS content FROM events"""
)
def snap_messages(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    e = table(s, d, "events")
    snap = _named(sender=F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("u"), _text(F.col("event_id") % 5))).otherwise(""), media_type=F.lit("IMAGE"), created=_stamp("ts"), title=F.lit("t"), is_sender=F.col("event_id") % 2 == 0, epoch=F.col("event_id"))
    threads = e.groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", snap.alias("m")))), lambda r: r["m"]).alias("rows"))
    rows = threads.groupBy(_text("user_id").alias("export_id")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "rows"))).alias("threads"))
    m = exports.snap_messages(exports.read_sections(_texts(rows, "snap_history.json", F.col("threads")))[0])
    return m.select("export_id", "conversation", "pos", "sender", "is_sender", x.stamp_text(F.col("created")).alias("created"), F.col("created_epoch_ms").alias("epoch"), "content")


@query(
    """SELECT o_custkey::VARCHAR AS export_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS entry_index, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'unknown' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90)::DOUBLE END AS lat, CASE WHEN o_orderkey % 3 = 0 THEN -1.5 END AS lon, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS place, CASE WHEN o_orderkey % 5 > 0 THEN 'https://m/' ELSE 'https://d/' END || o_orderkey AS url,
  CASE WHEN o_orderkey % 3 = 2 THEN 'coordinates' END AS error FROM orders"""
)
def memory_entries(s: SparkSession, d: str) -> DataFrame:
    # orders move as they are stored, before texts are made of them
    o = dealt(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_custkey")
    k, key = F.col("o_orderkey"), _text("o_orderkey")
    place = F.when(k % 3 == 0, F.concat(F.lit("Latitude, Longitude: "), _text(k % 90), F.lit(", -1.5"))).when(k % 3 == 1, F.col("o_orderpriority")).otherwise("Latitude, Longitude: 1")
    entry = _named(date=_stamp("o_orderdate"), media_type=F.when(k % 2 == 0, "Image").otherwise("Story"), location=place, link=F.concat(F.lit("https://d/"), key), direct=F.when(k % 5 > 0, F.concat(F.lit("https://m/"), key)).otherwise(""))
    rows = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("m")))), lambda r: r["m"]).alias("rows")).withColumn("export_id", _text("o_custkey"))
    out = exports.memory_entries(exports.read_sections(_texts(rows, "memories_history.json", F.struct(F.col("rows").alias("Saved Media"))))[0])
    return out.select("export_id", "entry_index", "day", "kind", "lat", "lon", "place", "url", F.col("error.kind").alias("error"))


def _struct(**pairs: Column) -> Column:
    """A struct with spaces for underscores in its fields' names and capitals at their words."""
    return F.struct(*(v.alias(" ".join(w if w.isupper() else w.capitalize() for w in k.split("_"))) for k, v in pairs.items()))


def account_sections(s: SparkSession, d: str) -> DataFrame:
    """Customers as accounts, and their nations' suppliers as devices; every ninth creation date is no date."""
    c = dealt(table(s, d, "customer"), "c_custkey")
    k = F.col("c_custkey")
    basic = _struct(Username=F.col("c_name"), Name=F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")), Creation_Date=F.when(k % 9 == 0, "soon").otherwise("2020-01-02 03:04:05 UTC"), Country=_text("c_nationkey"))
    device = F.array(_struct(Make=F.col("c_mktsegment"), Start_Time=F.when(k % 5 == 0, "").otherwise("2021-02-30 00:00:00 UTC")), _struct(Make=F.lit("m2"), Start_Time=F.lit("x")))
    logins = F.when(k % 2 == 0, F.array(_struct(IP=F.concat(F.lit("10.0.0."), _text(k % 250)), Created=F.lit("2022-01-01 00:00:00 UTC"))))
    linked = F.array(_struct(Device_ID=_text("c_custkey"), User_ID=F.col("c_name"), Request_Time=F.lit("2022-01-01 00:00:00 UTC")))
    body = F.struct(basic.alias("Basic Information"), device.alias("Device History"), logins.alias("Login History"), linked.alias("Associated Accounts by Cloud Account ID"))
    return exports.read_sections(_texts(c.withColumn("export_id", _text("c_custkey")), "account.json", body))[0]


@query(
    """SELECT c_custkey::VARCHAR AS export_id, c_name AS username, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 9 > 0 THEN '2020-01-02 03:04:05 UTC' END AS created, c_nationkey::VARCHAR AS country, NULL AS make,
  CASE WHEN c_custkey % 9 = 0 THEN 'Creation Date' END AS wrong FROM customer"""
)
def account_basics(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    t = exports.account_tables(account_sections(s, d))["basics"]
    at = "basic_information__"
    return t.select("export_id", F.col(at + "username").alias("username"), F.col(at + "name").alias("name"), x.stamp_text(F.col(at + "creation_date")).alias("created"), F.col(at + "country").alias("country"), F.col("device_information__make").alias("make"), F.col("error.field").alias("wrong"))


@query(
    """SELECT c_custkey::VARCHAR AS export_id, 'device' AS list, 0 AS pos, c_mktsegment AS name, CASE WHEN c_custkey % 5 > 0 THEN '2021-02-30 00:00:00 UTC' END AS at, NULL AS wrong FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'device', 1, 'm2', NULL, 1 FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'login', 0, '10.0.0.' || c_custkey % 250, '2022-01-01 00:00:00 UTC', NULL FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'linked', 0, c_name, '2022-01-01 00:00:00 UTC', NULL FROM customer"""
)
def account_lists(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    t = exports.account_tables(account_sections(s, d))
    pick = lambda table_, list_, name, at: t[table_].select("export_id", F.lit(list_).alias("list"), "pos", F.col(name).alias("name"), x.stamp_text(F.col(at)).alias("at"), F.col("error.n_chars").alias("wrong"))
    out = pick("device_history", "device", "make", "start_time").unionByName(pick("login_history", "login", "ip", "created"))
    return out.unionByName(pick("associated_accounts_by_cloud_account_id", "linked", "user_id", "request_time"))


@query(
    """SELECT c_custkey::VARCHAR AS export_id, list, 0 AS pos, CASE WHEN list <> 'shortcuts' THEN c_name END AS username, CASE WHEN list = 'shortcuts' THEN 's' WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS display_name,
  CASE WHEN list = 'shortcuts' OR c_custkey % 4 > 0 THEN '2020-01-02 03:04:05 UTC' END AS created, CASE WHEN list <> 'shortcuts' AND c_custkey % 4 = 0 THEN 'Creation Timestamp' END AS wrong
FROM customer, (SELECT unnest(['friends', 'blocked_users', 'shortcuts']) AS list)"""
)
def friends_long(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    c = dealt(table(s, d, "customer"), "c_custkey").withColumn("export_id", _text("c_custkey"))
    k = F.col("c_custkey")
    friend = F.array(_named(username=F.col("c_name"), display_name=F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), creation=F.when(k % 4 == 0, "never").otherwise("2020-01-02 03:04:05 UTC"), modified=F.lit("")))
    body = F.struct(friend.alias("Friends"), friend.alias("Blocked Users"), F.array(_struct(Shortcut_Name=F.lit("s"), Created=F.lit("2020-01-02 03:04:05 UTC"))).alias("Shortcuts"))
    out = exports.friends_long(exports.read_sections(_texts(c, "friends.json", body))[0])
    return out.select("export_id", "list", "pos", "username", "display_name", x.stamp_text(F.col("created")).alias("created"), F.col("error.field").alias("wrong"))


@query(
    """SELECT c_custkey::VARCHAR AS export_id, c_nationkey::VARCHAR AS country, CASE WHEN c_custkey % 6 > 0 THEN '2020-01-02 03:04:05 UTC' END AS created, (c_custkey % 3)::INT AS n_subscriptions, 'login' AS event, c_custkey AS occurrences, 'web' || c_custkey AS web FROM customer"""
)
def profile_tables(s: SparkSession, d: str) -> DataFrame:
    from heronry.functions import expr as x

    c = dealt(table(s, d, "customer"), "c_custkey").withColumn("export_id", _text("c_custkey"))
    k = F.col("c_custkey")
    body = F.struct(
        _struct(Country=_text("c_nationkey"), Creation_Time=F.when(k % 6 == 0, "").otherwise("2020-01-02 03:04:05 UTC")).alias("App Profile"), F.array_repeat(F.lit(1), (k % 3).cast("int")).alias("Subscriptions"),
        F.array(_struct(Event=F.lit("login"), Occurrences=k)).alias("Engagement"), F.struct(F.array(F.concat(F.lit("web"), _text("c_custkey"))).alias("Web Interactions")).alias("Interactions"),
    )
    t = exports.profile_tables(exports.read_sections(_texts(c, "user_profile.json", body))[0])
    basics = t["basics"].select("export_id", F.col("app_profile__country").alias("country"), x.stamp_text(F.col("app_profile__creation_time")).alias("created"), "n_subscriptions")
    return basics.join(t["engagement"].select("export_id", "event", "occurrences"), "export_id").join(t["interactions__web_interactions"].select("export_id", F.col("value").alias("web")), "export_id")


@query(
    """SELECT c_custkey::VARCHAR AS export_id, 'frequent' AS list, c_mktsegment AS city, c_nationkey::VARCHAR AS country FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'home', c_name, 'Home' FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'visited', 'x', '2' FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'areas', c_mktsegment, NULL FROM customer"""
)
def location_tables(s: SparkSession, d: str) -> DataFrame:
    c = dealt(table(s, d, "customer"), "c_custkey").withColumn("export_id", _text("c_custkey"))
    place = F.array(_struct(City=F.col("c_mktsegment"), Country=_text("c_nationkey"), Region=F.lit("")))
    body = F.struct(
        place.alias("Frequent Locations"), F.create_map(F.lit("Home"), F.col("c_name")).alias("Home, School & Work"), F.create_map(F.lit("x"), F.array(F.lit(1), F.lit(2))).alias("Businesses and places you may have visited"),
        F.array(_struct(City=F.col("c_mktsegment"), Time=F.lit("2020"))).alias("Areas you may have visited in the last two years"),
    )
    t = exports.location_tables(exports.read_sections(_texts(c, "location_history.json", body))[0])
    row = lambda name, list_, city, country: t[name].select("export_id", F.lit(list_).alias("list"), city.alias("city"), country.alias("country"))
    out = row("frequent_locations", "frequent", F.col("city"), F.col("country")).unionByName(row("home_school_and_work", "home", F.col("value"), F.col("key")))
    out = out.unionByName(row("businesses_and_places_you_may_have_visited", "visited", F.col("key"), F.size("value").cast("string")))
    return out.unionByName(row("areas_you_may_have_visited_in_the_last_two_years", "areas", F.col("city"), F.lit(None).cast("string")))


@query(
    """WITH s AS (SELECT o_custkey, least(sum(floor(o_totalprice)::BIGINT), 18446744073709551615::HUGEINT)::VARCHAR AS views, sum(o_orderkey % 7)::VARCHAR AS replies, count(*) AS stories FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS export_id, stories, views AS story_views, replies AS story_replies, o_custkey / 8 AS price FROM s"""
)
def story_totals(s: SparkSession, d: str) -> DataFrame:
    """Views and replies of each export's stories, with the price of its one subscription."""
    o = table(s, d, "orders")
    story = _struct(Story_Date=_text("o_orderdate"), Story_Views=F.floor("o_totalprice"), Story_Replies=F.col("o_orderkey") % 7)
    rows = o.groupBy("o_custkey").agg(F.collect_list(story).alias("rows")).withColumn("export_id", _text("o_custkey"))
    stories = exports.story_views(exports.read_sections(_texts(rows, "story_history.json", F.struct(F.col("rows").alias("Your Story Views"))))[0])
    paid = exports.subscriptions(exports.read_sections(_texts(rows, "snapchat_plus.json", F.struct(F.array(_struct(Price=F.col("o_custkey") / 8)).alias(""))))[0])
    out = reports.story_totals(stories).join(paid.select("export_id", "price"), "export_id")
    return out.select("export_id", "stories", _text("story_views").alias("story_views"), _text("story_replies").alias("story_replies"), "price")


@query("SELECT event_id::VARCHAR AS export_id, f AS file, json_extract(props, '$.k')::VARCHAR AS k FROM events, (SELECT unnest(['ranking.json', 'in_app_reports.json']) AS f)")
def passthrough(s: SparkSession, d: str) -> DataFrame:
    """Files that are kept as they are, as variants."""
    e = table(s, d, "events")
    files = F.explode(F.array(F.lit("ranking.json"), F.lit("in_app_reports.json"))).alias("file")
    sections = exports.read_sections(e.select(_text("event_id").alias("export_id"), files, F.col("props").alias("body")))[0]
    out = exports.passthrough(sections, "ranking.json").unionByName(exports.passthrough(sections, "in_app_reports.json"))
    return out.select("export_id", "file", F.try_variant_get("value", "$.k", "string").alias("k"))


# ---- files ----


@query(
    """SELECT l_orderkey::VARCHAR AS export_id, 'in/mydata~' || l_orderkey || '-2/a/chat_media/' || l_linenumber || '_' || l_suppkey || '.jpg' AS path, l_linenumber || '_' || l_suppkey || '.jpg' AS name FROM lineitem WHERE l_linenumber % 3 = 0"""
)
def media_listing(s: SparkSession, d: str) -> DataFrame:
    """Files right under a folder of that name; those further down and under others are none of it."""
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    folder = F.when(n % 3 == 0, "-2/a/chat_media/").when(n % 3 == 1, "/chat_media/deep/").otherwise("/memories/")
    listing = li.select(F.concat(F.lit("in/mydata~"), _text("l_orderkey"), folder, _text("l_linenumber"), F.lit("_"), _text("l_suppkey"), F.lit(".jpg")).alias("path"))
    return exports.media_listing(listing, "chat_media")


_PARTS = """p AS (SELECT l_orderkey, CASE WHEN l_linenumber = 0 THEN 1 ELSE l_linenumber + 1 END AS n, l_suppkey % 2 = 0 AS zipped FROM lineitem),
g AS (SELECT 'x' || l_orderkey AS id, coalesce(list_sort(list_distinct(list(n) FILTER (zipped))), []) AS zips, coalesce(list_sort(list_distinct(list(n) FILTER (NOT zipped))), []) AS folders FROM p GROUP BY 1)"""


def _parts(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    n = F.when(F.col("l_linenumber") == 0, "").otherwise(F.concat(F.lit("-"), _text(F.col("l_linenumber") + 1)))
    tail = F.when(F.col("l_suppkey") % 2 == 0, ".ZIP").otherwise("/")
    return exports.delivery_parts(li.select(F.concat(F.lit("in/mydata~x"), _text("l_orderkey"), n, tail).alias("path")))


@query(f"WITH {_PARTS} SELECT id, array_to_string(zips, ',') AS zips, array_to_string(folders, ',') AS folders FROM g")
def delivery_parts(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select("id", F.array_join("zips", ",").alias("zips"), F.array_join("folders", ",").alias("folders"))


@query(
    f"""WITH {_PARTS} SELECT 'x' || o_orderkey AS export_id, CASE WHEN g.id IS NULL THEN 'none' ELSE 'one' END AS state, len(zips)::INT AS zips, len(folders)::INT AS unpacked,
  array_to_string(list_filter(range(1, list_max(list_concat(zips, folders)) + 1), lambda i: NOT list_contains(list_concat(zips, folders), i)), ',') AS missing FROM orders LEFT JOIN g ON g.id = 'x' || o_orderkey"""
)
def source_state(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select(F.concat(F.lit("x"), _text("o_orderkey")).alias("export_id"))
    return reports.source_state(_parts(s, d), orders).select("export_id", "state", "zips", "unpacked", F.array_join("missing", ",").alias("missing"))


# ---- reports ----


@query(
    """SELECT (o_custkey % 16)::VARCHAR AS export_id, count(*) FILTER (k % 3 = 0) AS planned, count(*) FILTER (k % 3 = 1) AS deferred, count(*) FILTER (k % 3 = 2) AS excluded,
  CASE WHEN o_custkey % 16 < 12 THEN count(*) FILTER (k % 2 = 0) ELSE 0 END AS named, CASE WHEN o_custkey % 16 < 4 THEN 'absent' WHEN o_custkey % 16 < 12 AND count(*) FILTER (k % 2 = 0) > 0 THEN 'joined' ELSE 'joined_nothing' END AS history, count(*) FILTER (k % 3 = 1) > 0 AS partial
FROM (SELECT *, o_orderkey AS k FROM orders) GROUP BY o_custkey % 16"""
)
def plan_counts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    k, e = F.col("o_orderkey"), F.col("o_custkey") % 16
    rows = o.select(_text(e).alias("export_id"), F.when(k % 3 == 0, "planned").when(k % 3 == 1, "deferred").otherwise("excluded").alias("disposition"))
    sections = o.select(_text(e).alias("export_id"), F.lit("chat_history.json").alias("file"), F.when(e < 4, "absent").otherwise("loaded").alias("state")).distinct()
    named = o.select(_text(e).alias("export_id"), F.when((k % 2 == 0) & (e < 12), "named").otherwise("unnamed").alias("outcome"))
    return reports.plan_counts(rows, sections, named)


@query(
    """WITH e AS (SELECT DISTINCT conv_id AS c FROM conversations), m AS (SELECT conv_id AS c, count(*) AS messages FROM conversations GROUP BY 1), y AS (SELECT conv_id AS c, 2020 AS y FROM conversations WHERE turn % 7 > 0 AND conv_id % 10 < 8
  UNION ALL SELECT conv_id, 1970 FROM conversations WHERE turn % 7 = 0 AND turn % 3 > 0 AND conv_id % 10 < 8)
SELECT c::VARCHAR AS export_id, CASE WHEN c % 10 > 7 THEN 'broken' ELSE 'loaded' END AS messages_state, 'absent' AS entries_state, CASE WHEN c % 10 < 8 THEN messages END AS messages, min(y)::INT AS first_year, max(y)::INT AS last_year
FROM e JOIN m USING (c) LEFT JOIN y USING (c) GROUP BY ALL"""
)
def overview(s: SparkSession, d: str) -> DataFrame:
    sections, _ = exports.read_sections(chat_texts(s, d))
    out = reports.overview(sections, exports.memory_entries(sections), exports.chat_messages(sections), exports.friends_long(sections))
    return out.select("export_id", "messages_state", "entries_state", "messages", "first_year", "last_year")


@query("SELECT (conv_id % 4)::VARCHAR AS export_id, count(DISTINCT conv_id) AS conversations, 4 * count(DISTINCT conv_id) AS documents, count(DISTINCT conv_id) AS html, 'manifest' AS links FROM conversations GROUP BY 1")
def history_report(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(_text(F.col("conv_id") % 4).alias("export_id"), _text("conv_id").alias("conversation")).distinct()
    formats = F.explode(F.array(*map(F.lit, timeline.FORMATS))).alias("format")
    return reports.history_report(c.select("*", formats), True)


@query(
    """WITH k AS (SELECT conv_id, f FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([{}]) AS f))
SELECT conv_id::VARCHAR AS export_id, f AS file, 'lacking' AS side FROM k WHERE f <> 'friends.json' UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'x' || conv_id || '.json', 'unknown' FROM conversations""".format(", ".join(f"'{f}'" for f in exports.SECTION_FILES))
)
def known_files(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(_text("conv_id").alias("export_id")).distinct()
    present = c.select("export_id", F.explode(F.array(F.lit("friends.json"), F.concat(F.lit("x"), "export_id", F.lit(".json")))).alias("file"))
    lacking, unknown = reports.known_files(exports.read_sections(chat_texts(s, d))[0], present)
    return lacking.withColumn("side", F.lit("lacking")).unionByName(unknown.withColumn("side", F.lit("unknown")))


@query(sql("SELECT export_id, conversation, md5('{\"conversation\":\"' || any_value(conversation) || '\",\"records\":' || string_agg(seq::VARCHAR, ',' ORDER BY seq) || '}') AS digest, count(*) AS records FROM t GROUP BY ALL", "transcript"))
def transcript_json(s: SparkSession, d: str) -> DataFrame:
    """Documents in JSON, read again: their records in order, by number."""
    t = views.transcript(s, d).withColumn("content", _text("seq"))
    record = "struct<conversation: string, records: array<struct<kind: string, content: string>>>"
    docs = timeline.documents(t, "json").select("export_id", F.from_json("document", record).alias("j"))
    body = F.concat(F.lit('{"conversation":"'), "j.conversation", F.lit('","records":'), F.array_join(F.transform("j.records", lambda r: r["content"]), ","), F.lit("}"))
    return docs.select("export_id", F.col("j.conversation").alias("conversation"), F.md5(body).alias("digest"), F.size("j.records").cast("long").alias("records"))


@query(sql("SELECT export_id, conversation, count(*) + 1 AS pieces, 0 AS first_place, max(seq)::BIGINT AS last_place FROM t GROUP BY ALL", "transcript"))
def document_lines(s: SparkSession, d: str) -> DataFrame:
    """Pieces of CSV documents as the sink writes them."""
    lines = timeline.document_lines(views.transcript(s, d), "csv")
    return lines.groupBy("export_id", "conversation").agg(F.count(F.lit(1)).alias("pieces"), F.min("place").cast("int").alias("first_place"), F.max("place").alias("last_place"))


@query("SELECT user_id, event_id, pos, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS length FROM events) WHERE pos < 5")
def sample_arrays(s: SparkSession, d: str) -> DataFrame:
    from heronry.operators import redact

    e = table(s, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    rows = e.select(F.lit("e").alias("export_id"), F.lit("f").alias("file"), _text("user_id").alias("pointer"), F.col("pos").cast("long").alias("pos"), "user_id", "event_id")
    return redact.sample_arrays(rows, 5).select("user_id", "event_id", "pos", "length")


# ---- files, versions and streams ----


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/heronry-{name}-{uuid.uuid4().hex}"


@query(sql("SELECT export_id, conversation, source, pos, seq FROM timeline", "timeline"))
def wide_timeline(s: SparkSession, d: str) -> DataFrame:
    """The merged timeline with conversations of over 40 messages numbered by ranges of their order."""
    merged = timeline.merge_timeline(*views.histories(s, d), most=40)
    return merged.select("export_id", "conversation", "source", "pos", F.col("seq").cast("long").alias("seq"))


@query(sql("SELECT export_id, kind, source_id, status, retry_count, url, output_path, updated_at FROM items", "items"))
def published_items(s: SparkSession, d: str) -> DataFrame:
    """The status table as its latest published version, after one that holds less."""
    path, items = _folder(s, "items"), views.items(s, d)
    status.publish(items.filter("status = 'done'"), path, 1)
    status.publish(items, path, 2)
    return status.read_published(s, path).select("export_id", "kind", "source_id", "status", "retry_count", "url", "output_path", "updated_at")


#: Files that a round of landed_items has on disk at once: each takes 12 KB with its two folders.
LANDED_AT_ONCE = 100_000


def _memory_deliveries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as deliveries with two files, their orders as memories; even orders have a file in the listing. Customers
    of one segment have a folder that could not be read."""
    o = table(s, d, "orders").withColumn("export_id", _text("o_custkey"))
    entry = _named(date=_stamp("o_orderdate"), media_type=F.lit("Image"), link=F.concat(F.lit("https://d/"), _text("o_orderkey")))
    rows = o.groupBy("export_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("m")))), lambda r: r["m"]).alias("rows"))
    memories = _texts(rows, "memories_history.json", F.struct(F.col("rows").alias("Saved Media")))
    friends = _texts(rows, "friends.json", F.struct(F.array().cast("array<string>").alias("Friends")))
    h = F.md5(_text("o_orderkey"))
    name = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    listing = o.filter("o_orderkey % 2 = 0").select("export_id", F.concat(F.lit("m/memories/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), name, F.lit("-main.jpg")).alias("path"))
    gaps = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(_text("c_custkey").alias("export_id"))
    return memories.unionByName(friends), listing, gaps


@query(
    """WITH e AS (SELECT o_custkey::VARCHAR AS export_id, o_orderdate AS day, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS media FROM orders GROUP BY ALL),
m AS (SELECT e.export_id, n, media, n - media AS l, c_mktsegment = 'BUILDING' AS gap FROM e LEFT JOIN customer ON e.export_id = c_custkey::VARCHAR)
SELECT export_id, 'pending' AS status, sum(media)::BIGINT AS n, NULL AS note FROM m GROUP BY ALL HAVING sum(media) > 0
UNION ALL SELECT export_id, 'source_missing', sum(l)::BIGINT, CASE WHEN coalesce(gap, false) THEN 'scan_incomplete' ELSE 'no_media' END FROM m GROUP BY export_id, gap HAVING sum(l) > 0"""
)
def landed_items(s: SparkSession, d: str) -> DataFrame:
    """Deliveries written as files in two rounds and taken in as they land, up to the published status table. Files that
    were taken in are removed."""
    texts, listing, gaps = _memory_deliveries(s, d)
    root, out = _folder(s, "landing"), _folder(s, "status")
    # tasks that make and remove folders of one parent wait for each other
    path = F.concat(F.pmod(F.xxhash64("export_id"), F.lit(256)).cast("string"), F.lit("/mydata~"), "export_id", F.lit("/json/"), "file")
    progress, record = _folder(s, "progress"), _folder(s, "record")
    for version, file in enumerate(("friends.json", "memories_history.json"), 1):
        rows = texts.filter(F.col("file") == file).select(path.alias("path"), F.lit(0).alias("place"), F.col("body").alias("piece"))
        take = lambda keep=jobs.keep_texts(out, version): jobs.ingest(jobs.stream_landed(s, root, record, 1_000_000), keep, progress).awaitTermination()
        land(rows, root, record, LANDED_AT_ONCE, take)
        jobs.publish_deliveries(s, out, version, listing, gaps, 5)
    items = status.read_published(s, f"{out}/items")
    return items.groupBy("export_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("last_error").alias("note"))


@query(ORACLE_SQL["transcript_csv"])
def written_transcripts(s: SparkSession, d: str) -> DataFrame:
    """Documents written to the paths that the plan reserves for them, and read again from there."""
    rows, root, record = views.transcript(s, d), _folder(s, "transcripts"), _folder(s, "record")
    # written, as the documents and their names both need them
    dirs = cut(plan.document_names(plan.allocate_dirs(rows.select("export_id", "conversation").distinct()), {"csv": "csv"}), "dirs")
    timeline.write_transcripts(rows, root, "csv", dirs=dirs, record=record)
    # tasks open what the record names: a listing would pass every folder through the driver
    files = read_landed(dealt(s.read.schema("value string").text(record), "value"), root)
    at = F.split("path", "/")
    named = files.select(F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"), F.get(at, F.lit(0)).alias("export_id"), F.array_join(F.slice(at, 2, 2), "/").alias("document_path"))
    return named.join(dirs.select("export_id", "conversation", "document_path"), ["export_id", "document_path"]).select("export_id", "conversation", "digest", "n_chars")
