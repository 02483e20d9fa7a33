import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import places, plan, reconcile, redact, reports, status, timeline
from heronry.plans import views
from heronry.sources import exports, named_files
from heronry.streaming import jobs

ITEMS = status.SCHEMA


def item(key, state="pending", **more):
    base = {"export_id": "e", "kind": "memory", "source_id": key, "status": state, "retry_count": 0, "url": None, "output_path": None, "checksum": None, "bytes": None, "last_error": None, "updated_at": 1}
    return {**base, **more}


def frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) if isinstance(r, dict) else r for r in rows], schema)


def by_key(df):
    return {r.source_id: r for r in df.collect()}


def sequential_match(entries, media):
    """Plain rules: entries in order take media of their day, then those of the next and the previous day."""
    free = defaultdict(list)
    for day, kind, uuid in media:
        free[day, kind].append(uuid)
    for v in free.values():
        v.sort()
    n_e, n_m, out, left = defaultdict(int), {k: len(v) for k, v in free.items()}, {}, []
    for i, day, kind in entries:
        n_e[day, kind] += 1
    for i, day, kind in sorted(entries):
        if free[day, kind]:
            out[i] = (free[day, kind].pop(0), "exact" if n_e[day, kind] == n_m[day, kind] == 1 else "ambiguous")
        else:
            left.append((i, day, kind))
    for i, day, kind in left:
        at = date.fromisoformat(day)
        for step in (1, -1):
            near = free[(at + timedelta(days=step)).isoformat(), kind]
            if near:
                out[i] = (near.pop(0), "ambiguous")
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_memory_items_equal_the_sequential_rules(spark, seed):
    r = random.Random(seed)
    day = lambda: (date(2020, 1, 1) + timedelta(days=r.randint(0, 12))).isoformat()
    entries = [(i, day(), r.choice(["image", "video"])) for i in range(60)]
    media = [(day(), r.choice(["image", "video"]), f"u{i:03d}") for i in range(50)]
    e = spark.createDataFrame([("e", i, d, k, None, None) for i, d, k in entries], "export_id string, entry_index long, day string, kind string, lat double, lon double")
    m = spark.createDataFrame([("e", d, k, u) for d, k, u in media], "export_id string, day string, kind string, uuid string")
    got = reconcile.memory_items(e, m, spark.createDataFrame([], "export_id string")).collect()
    assert len(got) == 60
    assert {x.entry_index: (x.uuid, x.confidence) for x in got if x.uuid} == sequential_match(entries, media)


def test_missing_reasons(spark):
    e = spark.createDataFrame([("a", 0, None, "image", None, None), ("b", 1, "2020-01-01", "image", None, None), ("c", 2, "2020-01-01", "image", None, None)], "export_id string, entry_index long, day string, kind string, lat double, lon double")
    m = spark.createDataFrame([], "export_id string, day string, kind string, uuid string")
    got = {r.export_id: (r.reason, r.source_id) for r in reconcile.memory_items(e, m, spark.createDataFrame([("b",)], "export_id string")).collect()}
    assert got == {"a": ("no_date", "unpaired-entry-0"), "b": ("scan_incomplete", "unpaired-entry-1"), "c": ("no_media", "unpaired-entry-2")}


def test_zones_take_the_first_name_and_polygons(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0), (3, 0.2, 3.9)], "id long, lat double, lon double")
    zones = spark.createDataFrame([("b", 0.0, 4.0, 0.0, 4.0, None), ("a", 0.0, 2.0, 0.0, 2.0, None), ("a3", 0.0, 4.0, 0.0, 4.0, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0)])], "zone string, min_lat double, max_lat double, min_lon double, max_lon double, polygon array<struct<lat: double, lon: double>>")
    assert {r.id: r.zone for r in reconcile.assign_zone(points, zones).collect()} == {1: "a", 2: None, 3: "b"}


def in_ring(lat, lon, ring):
    n = len(ring)
    return sum((a[0] > lat) != (b[0] > lat) and lon < (b[1] - a[1]) * (lat - a[0]) / (b[0] - a[0]) + a[1] for a, b in ((ring[i], ring[(i + 1) % n]) for i in range(n))) % 2 == 1


def plain_zone(lat, lon, zones):
    held = []
    for name, low, high, left, right, polygon, holes in zones:
        past = left > right
        along = lambda o: o + 360 if past and o < left else o  # noqa: E731, B023
        turn = lambda ring: [(a, along(o)) for a, o in ring]  # noqa: E731, B023
        if lat is None or lon is None or not (low <= lat <= high and left <= along(lon) <= (right + 360 if past else right)):
            continue
        if (polygon is None or in_ring(lat, along(lon), turn(polygon))) and not any(in_ring(lat, along(lon), turn(h)) for h in holes or []):
            held.append(name)
    return min(held, default=None)


@pytest.mark.parametrize("cells", [16, 64, 400])
def test_zones_equal_brute_force(spark, cells):
    import math

    from heronry.operators import zones

    r = random.Random(cells)

    def star(lat, lon, size, n):
        turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        return [(lat + size * r.uniform(0.4, 1) * math.sin(t), lon + size * r.uniform(0.4, 1) * math.cos(t)) for t in turns]

    shapes = [("box", -10.0, 10.0, -20.0, 20.0, None, None), ("pacific", -30.0, 30.0, 160.0, -150.0, None, [star(0, 179, 5, 7)]), ("east", -5.0, 5.0, 181.0, 190.0, None, None), ("none", 5.0, -5.0, 0.0, 1.0, None, None), ("flat", 50.0, 60.0, 0.0, 9.0, [], None)]
    for i in range(14):
        lat, lon, size = r.uniform(-70, 70), r.uniform(-170, 170), r.choice([0.01, 1.0, 15.0])
        ring = star(lat, lon, size, r.choice([3, 8, 60]))
        lats, lons = zip(*ring)
        shapes.append((f"z{i % 9}", min(lats), max(lats), min(lons), max(lons), ring, [star(lat, lon, size / 5, 5)] if i % 2 else None))
    # a polygon on both sides of the antimeridian
    ring = [(a, (o + 180) % 360 - 180) for a, o in star(-40, 181, 12, 20)]
    shapes.append(("dateline", min(a for a, _ in ring), max(a for a, _ in ring), min(o for _, o in ring if o > 0), max(o for _, o in ring if o < 0), ring, None))
    places = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(900)] + [(r.uniform(-60, 60), r.choice([r.uniform(150, 200), r.uniform(-180, -140)])) for _ in range(300)]
    for _, low, high, left, right, polygon, _ in shapes:
        places += [(low, left), (high, right), *(polygon or [])]
        places += [(r.uniform(min(low, high), max(low, high)), r.uniform(left, right)) for _ in range(30)]
    places += [(None, 1.0), (0.0, None), (0.0, 180.0), (0.0, -180.0), (90.0, 0.0), (0.0, 185.0)]
    ring_type = "array<struct<lat: double, lon: double>>"
    df = spark.createDataFrame(shapes, f"zone string, min_lat double, max_lat double, min_lon double, max_lon double, polygon {ring_type}, holes array<{ring_type}>")
    points = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(places)] + [(None, 0.0, 0.0), (0, 0.0, 0.0)], "id long, lat double, lon double").withColumn("x", F.lit(1))
    out = zones.assign_zone(points, df, cells)
    assert out.columns == ["id", "lat", "lon", "x", "zone"]
    got = out.collect()
    assert len(got) == len(places) + 2
    assert [v for v in got if v.zone != plain_zone(v.lat, v.lon, shapes)] == []
    for _, low, high, left, right, polygon, holes in shapes:
        as_arrays = [np.array(list(zip(*ring)), float) if ring else np.zeros((2, 0)) for ring in [polygon or [], *(holes or [])]]
        if left <= right and low <= high:
            assert len(zones.covering((low, high, left, right), None if polygon is None else tuple(as_arrays[0]), [tuple(h) for h in as_arrays[1:]], cells)) <= cells
    assert {v.zone for v in zones.assign_zone(points, df.limit(0)).collect()} == {None} and zones.assign_zone(points.limit(0), df).count() == 0


def test_sections(spark):
    body = '{"c1": [{"From": "a", "Media Type": "Text", "Created": "2020-01-01 00:00:00 UTC", "Content": "hi", "IsSender": true, "Created(microseconds)": 5}, {"From": "", "Created": "bad", "Unknown": 1}], "": []}'
    texts = spark.createDataFrame([("e", "chat_history.json", body), ("e", "friends.json", '{"Friends": [{"Username": "u"}], "Shortcuts": [{"Shortcut Name": "s"}]}'), ("e", "ranking.json", "[1]"), ("e", "snap_history.json", "{broken"), ("e", "memories_history.json", '{"a": 1, "a": 2}')], "export_id string, file string, body string")
    sections, errors = exports.read_sections(texts)
    assert sections.count() == 20
    assert {(r.file, r.kind) for r in errors.collect()} == {("ranking.json", "shape"), ("snap_history.json", "syntax"), ("memories_history.json", "duplicate_key")}
    chat = sorted(exports.chat_messages(sections).collect(), key=lambda r: r.pos)
    assert [(r.conversation, r.pos, r.sender, r.media_type, r.content) for r in chat] == [("c1", 0, "a", "TEXT", "hi"), ("c1", 1, None, "", None)]
    assert chat[1].error.n_chars == 3 and chat[0].error is None
    with pytest.raises(ValueError, match="timestamp"):
        exports.fail_on_errors(exports.table_errors(exports.chat_messages(sections)))
    assert {(r.list, r.username or r.display_name) for r in exports.friends_long(sections).collect()} == {("friends", "u"), ("shortcuts", "s")}


def test_reading_a_tree(spark, tmp_path):
    for name, text in (("mydata~1/json/memories_history.json", '{"Saved Media":\n [{"Date": "2020-01-01 00:00:00 UTC",\n"Media Type": "Image", "Location": "Latitude, Longitude: 1, 2", "Download Link": "l"}]}'), ("mydata~1-2/memories/x.jpg", "x"), ("mydata~1-2/memories/deep/y.jpg", "y")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    sections, errors = exports.read_sections(exports.read_texts(spark, str(tmp_path)))
    entry = exports.memory_entries(sections).first()
    assert (entry.export_id, entry.day, entry.kind, entry.lat, entry.url) == ("1", "2020-01-01", "image", 1.0, "l") and errors.count() == 0
    files = exports.list_files(spark, str(tmp_path))
    assert [(r.export_id, r.name) for r in exports.media_listing(files, "memories").collect()] == [("1", "x.jpg")]
    parts = exports.delivery_parts(spark.createDataFrame([("a/mydata~1.zip",), ("a/mydata~1-3/",)], "path string"))
    assert reports.missing_parts(parts).first().missing == [2]


def test_timeline_order(spark):
    chat = [("e", "c", "chat", 0, None, None), ("e", "c", "chat", 1, (2020, 1, 1, 0, 0, 0), 5), ("e", "c", "chat", 2, (2020, 1, 1, 0, 0, 0), None)]
    snap = [("e", "c", "snap", 0, (2020, 1, 1, 0, 0, 0), None), ("e", "c", "snap", 1, None, 1577836799000)]
    schema = "export_id string, conversation string, source string, pos long, created struct<year: int, month: int, day: int, hour: int, minute: int, second: int>, created_epoch_ms long"
    got = timeline.merge_timeline(spark.createDataFrame(chat, schema), spark.createDataFrame(snap, schema)).orderBy("seq").collect()
    assert [(r.source, r.pos) for r in got] == [("snap", 1), ("chat", 2), ("snap", 0), ("chat", 1), ("chat", 0)]


def test_links_and_html(spark):
    t = spark.createDataFrame([("e", "c", 1, "b~1|B~2|zz", "chat", "s", "MEDIA", None, None, None, True)], "export_id string, conversation string, seq int, media_ids string, source string, sender string, media_type string, resolved struct<year: int, month: int, day: int, hour: int, minute: int, second: int>, content string, title string, is_sender boolean")
    items = frame(spark, [item("b~1", "done", kind="chat_media", output_path="/o/f<1>.jpg", checksum="x", bytes=1), item("b~2", "failed", kind="chat_media")], ITEMS)
    linked = timeline.resolve_links(t, items)
    assert linked.first().links == ["f<1>.jpg", None, None]
    html = timeline.documents(linked, "html", True).first().document
    assert '<a href="f&lt;1&gt;.jpg">f&lt;1&gt;.jpg</a>' in html and html.count("media-placeholder") == 2
    assert '"media_ids":"b~1|B~2|zz"' in timeline.documents(linked, "json").first().document


def test_paths_keep_reserve_and_count(spark):
    rows = spark.createDataFrame([("e", k, i, "/o/2020", "s", "jpg") for i, k in enumerate("abcd")], "export_id string, source_id string, n int, dir string, stem string, ext string")
    rec = spark.createDataFrame([("e", "b", "/o/2020/S_3.jpg"), ("e", "zz", "/o/2020/s.jpg"), ("e", "c", "/elsewhere/s.jpg")], "export_id string, source_id string, output_path string")
    got = {r.source_id: r.output_path for r in plan.allocate_paths(rows, rec, ["n"]).collect()}
    assert got == {"a": "/o/2020/s_2.jpg", "b": "/o/2020/S_3.jpg", "c": "/o/2020/s_4.jpg", "d": "/o/2020/s_5.jpg"}


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_free_numbers_equal_counting(spark, most):
    r = random.Random(most)
    rows = [(g, i, r.randint(0, 9)) for g in ("a", "b", None, "c") for i in range({"a": 150, "b": 3}.get(g, 30))]
    held = [(g, n) for g in ("a", "b", None, "z") for n in {r.randint(-2, 200) for _ in range(60)} | {10**12}] + [("a", None)]
    want = {}
    for g in {g for g, _, _ in rows}:
        taken, n = {n for h, n in held if h == g}, 1
        for _, i, _ in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            while n in taken:
                n += 1
            want[g, i], n = n, n + 1
    df = spark.createDataFrame(rows, "g string, i int, o int").withColumn("mine", F.lit("x"))
    out = places.free_numbers(df, spark.createDataFrame(held, "g string, n long"), ["g"], [F.col("o"), F.col("i")], "n", 1, most)
    assert set(out.columns) == {"g", "i", "o", "mine", "n"} and {(v.g, v.i): v.n for v in out.collect()} == want
    assert places.free_numbers(df.limit(0), spark.createDataFrame(held, "g string, n long"), ["g"], [F.col("i")], "n").count() == 0


def walk(keys, reserved):
    taken, out = {r.lower() for r in reserved}, {}
    for k, name in sorted(keys):
        n, now = 1, name
        while now.lower() in taken:
            n += 1
            now = f"{name}_{n}"
        taken.add(now.lower())
        out[k] = now
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dirs_equal_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    keys = {r.choice(["a", "A", "b"]) + r.choice(["", "_2", "_3", "_2_2"]) + r.choice(["", "/", "?"]) for _ in range(25)} | {"_no-conversation"}
    from heronry.functions import expr as x

    df = spark.createDataFrame([("e", k) for k in keys], "export_id string, conversation string").withColumn("n", x.dir_name(F.col("conversation")))
    names = [(v.conversation, v.n) for v in df.collect()]
    got = {v.conversation: v.dir for v in plan.allocate_dirs(df).collect()}
    assert got == walk(names, ["_no-conversation"])


def test_dirs_keep_their_places(spark):
    keys = spark.createDataFrame([("e", "x"), ("e", "y"), ("e", "z")], "export_id string, conversation string")
    rec = spark.createDataFrame([("e", "x", "d"), ("e", "y", "d"), ("e", "y", "d2"), ("e", "gone", "z")], "export_id string, conversation string, dir string")
    got = {r.conversation: (r.dir, r.adopted) for r in plan.allocate_dirs(keys, rec).collect()}
    assert got == {"x": ("d", True), "y": ("d2", True), "z": ("z_2", False)}


def test_dirs_with_long_chains_of_suffixes(spark):
    """Two conversations never get one directory, however many suffixes a name has."""
    from heronry.functions import expr as x

    names = ["a" + "_2" * n for n in range(11)] + ["A" + "_2" * 7, "A" + "_2" * 9, "a?", "b_3_2", "b", "b?", "c_2", "c_2?", "_7", "_7?", "_7_2"]
    df = spark.createDataFrame([(e, k) for e in ("e", "f") for k in names], "export_id string, conversation string").withColumn("n", x.dir_name(F.col("conversation")))
    want = walk([(v.conversation, v.n) for v in df.filter("export_id = 'e'").collect()], ["_no-conversation"])
    out = plan.allocate_dirs(df, occupied=spark.createDataFrame([("f", "zz")], "export_id string, dir string")).collect()
    assert {(v.export_id, v.conversation): v.dir for v in out} == {(e, k): d for e in ("e", "f") for k, d in want.items()}
    taken = plan.allocate_dirs(df, occupied=spark.createDataFrame([("f", "b_2"), ("f", "C_2_2")], "export_id string, dir string")).collect()
    want_f = walk([(v.conversation, v.n) for v in df.filter("export_id = 'f'").collect()], ["_no-conversation", "b_2", "C_2_2"])
    assert {v.conversation: v.dir for v in taken if v.export_id == "f"} == want_f and {v.conversation: v.dir for v in taken if v.export_id == "e"} == want


def test_copies(spark):
    rows = spark.createDataFrame([("e", "/o", 0, 0, "a", "jpg"), ("e", "/o", 0, 1, "A", "JPG"), ("e", "/o", 1, 0, "a_2", "jpg"), ("e", "/o", 2, 0, "a", "png")], "export_id string, dir string, seq int, part int, stem string, ext string")
    assert sorted(r.copy for r in plan.allocate_copies(rows).collect()) == ["A_2.JPG", "a.jpg", "a.png", "a_2_2.jpg"]


def test_status_rules(spark):
    items = frame(spark, [item("a", url="https://h/secretsecret1"), item("b", "done", output_path="/o/b", checksum="c", bytes=3), item("c", "source_missing", last_error="no_media", checksum="k", output_path="/o/c", bytes=1), item("d", "excluded", last_error=status.EXCLUDED_NOTE)], ITEMS)
    key = lambda *ks, **more: frame(spark, [("e", "memory", k, *more.values()) for k in ks], ", ".join(["export_id string, kind string, source_id string", *(f"{n} string" for n in more)]))
    a = by_key(status.mark_failed(items, key("a", note="bad secretsecret1 x"), 9))["a"]
    assert (a.status, a.retry_count, a.last_error, a.updated_at) == ("failed", 1, "bad <redacted> x", 9)
    c = by_key(status.mark_source_missing(items, key("c", note="no_media"), 9))["c"]
    assert (c.updated_at, c.checksum) == (1, "k")
    assert by_key(status.exclude(items, key("d", "b"), 9))["d"].updated_at == 1
    assert by_key(status.exclude(items, key("b"), 9))["b"].checksum == "c"
    back = by_key(status.reset(items, key("c"), 9))["c"]
    assert (back.status, back.checksum, back.last_error) == ("pending", None, None)
    with pytest.raises(KeyError):
        status.require_known(items, key("nobody"))
    files = spark.createDataFrame([("/o/b", "other", 3)], "path string, checksum string, bytes long")
    after, verdicts = status.resume(items, files, 9)
    assert by_key(after)["b"].last_error == status.RESUME_NOTES["changed"] and verdicts.first().verdict == "changed"
    assert status.resume_report(after, verdicts).first().sent_back == 1
    assert status.record_violations(after).count() == 0 and status.elsewhere(items, "/o").count() == 0 and status.elsewhere(items, "/x").count() == 1


def test_second_run(spark):
    items = frame(spark, [item("gone", "pending"), item("back", "retired"), item("still", "source_missing", last_error="no_media"), item("done", "done", output_path="/o", checksum="c", bytes=1), item("claim", "claimed", output_path="/d")], ITEMS)
    found = spark.createDataFrame([("e", "back", None, None), ("e", "still", None, "no_media"), ("e", "new", "u", None)], "export_id string, source_id string, url string, reason string")
    none = spark.createDataFrame([], "export_id string")
    got = {k: r.status for k, r in by_key(status.enroll_reconciliation(items, found, none, "memory", 9)).items()}
    assert got == {"gone": "retired", "back": "pending", "still": "source_missing", "done": "done", "claim": "claimed", "new": "pending"}
    gap = spark.createDataFrame([("e",)], "export_id string")
    assert by_key(status.enroll_reconciliation(items, found, gap, "memory", 9))["gone"].status == "pending"


def test_claims(spark):
    items = frame(spark, [item("c1", "claimed", kind="history_export", output_path="/d/a")], ITEMS)
    facts = spark.createDataFrame([("e", "c1", "/d/a"), ("e", "c2", "/d/b")], "export_id string, source_id string, directory string")
    got = by_key(status.claim_directories(items, facts, 9))
    assert got["c1"].updated_at == 1 and got["c2"].output_path == "/d/b" and status.claims(status.claim_directories(items, facts, 9)).count() == 2


def test_redaction_round_trip_and_leaks(spark):
    body = '{"username": "marielle", "Created": "2020-01-02 03:04:05 UTC", "n": 0, "list": [{"Latitude": 48.8566, "ok": true}, null, ""], "u": "https://h.example/p?id=7&z=1", "t": "private words here"}'
    corpus = spark.createDataFrame([("e", "f.json", body)], "export_id string, file string, body string")
    rows = redact.leaves(spark, corpus, 6)
    assert {r.pointer: r.value for r in rows.collect()}["/list/0/Latitude"] == "48.8566"
    import json

    assert json.loads(redact.renest(rows, "value").first().body) == json.loads(body)
    out = {r.pointer: r.out for r in redact.synthesise(rows, "s", 86_400).collect()}
    assert out["/username"] == "user_1" and out["/Created"] == "2020-01-03 03:04:05 UTC" and out["/n"] == "0" and out["/u"] == "https://redacted.invalid/REDACTED?id=REDACTED&REDACTED=REDACTED"
    assert out["/list/0/Latitude"].startswith("1.") and len(out["/list/0/Latitude"]) == 6 and out["/t"].startswith("redacted-")
    leaked = spark.createDataFrame([("f", "/t", "string", "marielle at https://h.example/x 4711")], "file string, pointer string, kind string, value string")
    found = {r.rule for r in redact.leak_check(leaked, spark.createDataFrame([("4711",)], "token string")).collect()}
    assert found == {"live_url", "token"}


def test_leaves_of_any_depth(spark):
    import json

    body = '{"username": "marielle", "latitude": 48.8566, "q": "[{\\"[", "e": [], "o": {}}'
    for i in range(9):
        body = f'{{"a{i}": [{body}, {i}]}}'
    corpus = spark.createDataFrame([("e", "deep", body), ("e", "flat", '{"n": "x]"}'), ("e", "plain", "7"), ("e", "bad", "[[[")], "export_id string, file string, body string")
    rows = redact.leaves(spark, corpus)
    got = rows.collect()
    assert {r.value for r in got if r.kind == "nested"} == {"[]", "{}"} and {r.value for r in got if r.key == "username"} == {"marielle"}
    def walk(node, at=""):
        inner = node.items() if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else ()
        return {at: node} if not inner else {k: v for i, x in inner for k, v in walk(x, f"{at}/{i}").items()}

    assert {r.pointer for r in got if r.file == "deep"} == set(walk(json.loads(body)))
    out = " ".join(r.out for r in redact.synthesise(rows, "s", 0).collect())
    assert "marielle" not in out and "48.8566" not in out
    with pytest.raises(Exception, match="not opened: f"):
        redact.synthesise(spark.createDataFrame([("e", "f", "/a", "a", "", "nested", '{"b":1}', [("a", None, None)])], rows.schema), "s", 0).collect()


def test_leaks_behind_the_first_match(spark):
    ok = "https://redacted.invalid/REDACTED?id=REDACTED&REDACTED=REDACTED#REDACTED"
    run = "a1" * 16
    values = {
        "second": f"{ok} https://h.example/", "path": "https://redacted.invalid/a", "user": "https://u@redacted.invalid/", "parameter": "https://redacted.invalid/?id=7", "name": "https://redacted.invalid/?zz=REDACTED",
        "fragment": "https://redacted.invalid/#a", "clean": f"({ok}).", "runs": f"{run} {run}b", "longitude": "Latitude, Longitude: 1.5, 48.1", "inner": "at 1.25, 1.5 or 1.5 , -9.75", "pair": "1.25, 1.5", "number": "0 17",
    }
    out = spark.createDataFrame([(k, "/t", "string", v) for k, v in values.items()], "file string, pointer string, kind string, value string")
    got = sorted((r.file, r.rule, r.n_chars) for r in redact.leak_check(out, spark.createDataFrame([("1",), ("25",), ("5",)], "token string")).collect() if r.rule not in ("token", "number") or r.file == "number")
    want = [(k, "live_url", len(values[k])) for k in ("path", "user", "parameter", "name", "fragment")] + [("second", "live_url", 18), ("runs", "long_run", 32), ("runs", "long_run", 33), ("longitude", "coordinate", 30), ("inner", "coordinate", 11), ("number", "number", 2)]
    assert got == sorted(want)


def test_masking_rules(spark):
    rows = spark.createDataFrame([("e", "a.json", "/x/1/y"), ("e", "b.json", "/x")], "export_id string, file string, pointer string")
    rules = spark.createDataFrame([("r1", "a*.json", "/x/*/y"), ("r2", "*", "/nothing")], "rule string, file_glob string, pointer string").select("rule", "file_glob", F.col("pointer"))
    met, unused = redact.rule_hits(rows.withColumnRenamed("pointer", "pointer"), rules)
    assert [r.rule for r in met.collect()] == ["r1"] and [r.rule for r in unused.collect()] == ["r2"]


NAMED = {
    "chat_history.json": {"marielle.dupont": [{"From": "marielle.dupont", "user_id": 4711, "Conversation ID": "11111111-2222-3333-4444-555555555555"}], "Received  Saved Chat History": [], "paul": {"paul": 0}},
    "other.json": {"to": "paul", "by": [{"eve/l": [1]}], "id": "11111111-2222-3333-4444-555555555555", "sender": 4711, "note": "11111111-2222-3333-4444-555555555556", "7": {"7": "x", "12": {"0": []}}},
}


def named_corpus(spark):
    import json

    return spark.createDataFrame([("e", f, json.dumps(v)) for f, v in NAMED.items()], "export_id string, file string, body string")


def test_keys_are_masked_and_join(spark):
    import json

    rules = (*redact.BUILTIN_RULES, redact.MaskRule("other*:/by/*"))
    rows = redact.leaves(spark, named_corpus(spark), rules=rules)
    assert redact.unused_rules(rows, rules) == []
    out = redact.synthesise(rows, "s", 0)
    docs = {r.file: json.loads(r.body) for r in redact.renest(out).collect()}
    chat, other = docs["chat_history.json"], docs["other.json"]
    marielle, paul = chat_keys = next(k for k in chat if isinstance(chat[k], list) and chat[k]), other["to"]
    assert set(chat) == {marielle, paul, "Received  Saved Chat History"} and all(k.startswith("user_") for k in chat_keys)
    message = chat[marielle][0]
    assert message["From"] == marielle and message["user_id"] == other["sender"] != 4711 and len(str(message["user_id"])) == 4
    assert message["Conversation ID"] == other["id"] != NAMED["other.json"]["id"] and other["note"] == redact.ZERO_UUID
    assert list(other["by"][0])[0].startswith("key_") and list(chat[paul]) == ["paul"]  # only the top level is keyed by names
    pointers = " ".join(r.pointer for r in out.collect())
    assert "marielle" not in pointers and "eve" not in pointers and f"/{marielle}/0/From" in pointers
    tallied = {r.file: (r.masked, r.kept) for r in redact.key_tallies(out).collect()}
    assert tallied == {"chat_history.json": (2, 1), "other.json": (1, 0)}
    with pytest.raises(ValueError, match="cover no object.*nowhere"):
        redact.require_used(rows, (*rules, redact.MaskRule("/nowhere")))
    with pytest.raises(ValueError, match="FILE"):
        redact.MaskRule("x:y")


def test_a_key_left_in_on_purpose_is_found(spark):
    out = redact.synthesise(redact.leaves(spark, named_corpus(spark), rules=()), "s", 0)
    values = out.select("file", "pointer", "kind", F.col("out").alias("value")).filter("value is not null")
    known = ("Conversation", "sender")
    found = redact.leak_check(redact.key_texts(out), redact.generated_tokens(out), (*known, "received", "history")).collect()
    assert {(r.file, r.rule, r.n_chars) for r in found if r.rule == "token"} == {("chat_history.json", "token", 8), ("chat_history.json", "token", 6)}
    masked = redact.synthesise(redact.leaves(spark, named_corpus(spark)), "s", 0)
    assert redact.leak_check(redact.key_texts(masked), redact.generated_tokens(masked), (*known, "received", "history")).filter("rule = 'token'").count() == 0
    assert redact.leak_check(values, redact.generated_tokens(out)).filter("rule = 'token'").count() == 0


def test_random_documents_come_back(spark):
    import json
    import random

    rng = random.Random(5)

    def node(depth):
        pick = rng.random()
        if depth == 0 or pick < 0.3:
            return rng.choice([None, True, False, 0, -12, 3.5, "", "x", 'q"\\/~\n', "é"])
        keys = ["0", "1", "7", "12", "a/b", "~", "", "k", 'q"', " "]
        return [node(depth - 1) for _ in range(rng.randrange(4))] if pick < 0.6 else {k: node(depth - 1) for k in rng.sample(keys, rng.randrange(5))}

    docs = {str(i): node(5) for i in range(60)}
    corpus = spark.createDataFrame([("e", k, json.dumps(v)) for k, v in docs.items()], "export_id string, file string, body string")
    back = {r.file: json.loads(r.body) for r in redact.renest(redact.leaves(spark, corpus), "value").collect()}
    assert back == docs
    with pytest.raises(Exception, match="beyond doubles"):
        redact.leaves(spark, spark.createDataFrame([("e", "f", "[1e400]")], corpus.schema)).collect()


def test_numbers_of_a_width_are_permuted(spark):
    for width in (1, 2, 3, 4):
        low = 0 if width == 1 else 10 ** (width - 1)
        df = spark.range(low, 10**width).select(F.col("id").cast("string").alias("v"))
        got = [r[0] for r in df.select(redact.stand_in_number(F.col("v"), "s").alias("o")).collect()]
        assert sorted(map(int, got)) == list(range(low, 10**width)) and (width == 1 or got != [str(i) for i in range(low, 10**width)])
    odd = ["-42", "1000000000000000000", "9223372036854775807", "-0", "x"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in odd], "v string").select(redact.stand_in_number(F.col("v"), "s")).collect()]
    assert got[0][0] == "-" and len(got[0]) == 3 and [len(g) for g in got[1:3]] == [19, 19] and got[4] is None


def test_date_shapes(spark):
    given = ["2020-02-28", "2020/02/28", "02/28/2020", "2020-02-28T23:00:00Z", "2020-02-28 23:00:00 GMT", "2020-02-28 23:00:00.25+01:00", "2020-02-28 23:00:00 -0330", "2020/02/30", "13/28/2020", "2020-02-28 23:00:00 CET", "2020-02-28 23:00:00.1234567890"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "v string").select(redact.shift_date(F.col("v"), 7200)).collect()]
    assert got == ["2020-02-28", "2020/02/28", "02/28/2020", "2020-02-29T01:00:00Z", "2020-02-29 01:00:00 GMT", "2020-02-29 01:00:00.74+01:00", "2020-02-29 01:00:00 -0330", None, None, None, None]


def test_known_hosts_stay(spark):
    corpus = spark.createDataFrame([("e", "f", '{"a": "https://cdn.example/x?id=1", "b": "https://u@cdn.example/"}')], "export_id string, file string, body string")
    out = {r.key: r.out for r in redact.synthesise(redact.leaves(spark, corpus), "s", 0, ("cdn.example",)).collect()}
    assert out == {"a": "https://cdn.example/REDACTED?id=REDACTED", "b": "https://redacted.invalid/"}


def test_streamed_outcomes_equal_the_batch(spark, tmp_path):
    """Events in any order, in any batches."""
    import random

    rng, source, got = random.Random(1), tmp_path / "in", {}
    events = [("e", "memory", k, i, rng.choice(["done", "failed", "failed", "reset", "missing"])) for i, k in enumerate(rng.choices("abcde", k=60))]
    want = {r.source_id: (r.status, r.retry_count, r.n_events) for r in status.fold_outcomes(spark.createDataFrame(events, jobs.EVENT_SCHEMA)).collect()}
    rng.shuffle(events)
    source.mkdir()
    for part in (events[:20], events[20:45], events[45:]):
        spark.createDataFrame(part, jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        keep = lambda df, _: got.update({r.source_id: (r.status, r.retry_count, r.n_events) for r in df.collect()})
        stream = jobs.fold_stream(spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(str(source)))
        stream.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    assert got == want


class State:
    """What a state does for a group: held between calls, timed out when told so."""

    def __init__(self):
        self.held, self.hasTimedOut, self.waits = None, False, None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def remove(self):
        self.held = None

    def setTimeoutDuration(self, ms):
        self.waits = ms


def test_state_ends():
    import pandas as pd

    key, state = ("e", "memory", "a"), State()
    fold = lambda *events: [tuple(f.iloc[0])[3:] for f in jobs._fold(key, iter([pd.DataFrame(list(events), columns=["seq", "event"])] if events else []), state, 500)]
    assert fold((2, "failed"), (1, "failed")) == [("failed", 2, 2, 2)] and state.waits == 500
    assert fold((5, "done"), (3, "reset")) == [("done", 0, 5, 4)]
    state.hasTimedOut = True
    assert fold() == [] and not state.exists
    state.hasTimedOut = False
    assert fold((4, "failed")) == [("failed", 1, 4, 1)]


def test_ingest(spark, tmp_path):
    f = tmp_path / "mydata~9" / "json" / "friends.json"
    f.parent.mkdir(parents=True)
    f.write_text('{"Friends": []}')
    out = str(tmp_path / "out")
    jobs.ingest(jobs.stream_texts(spark, str(tmp_path / "mydata~9")), jobs.write_batches(out), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{out}/sections").filter("state = 'loaded'").first().file == "friends.json"


def test_transcript_files(spark, tmp_path):
    import json

    made = (2020, 1, 1, 0, 0, 0)
    rows = [("e", 'c"1', i, "chat", f"s{i}", "TEXT", made, f"=line one\nline {i}", None, "T" if i == 2 else None, i % 2 == 0, None, 0) for i in (1, 2, 3)] + [("e", "d", 1, "snap", None, "IMAGE", None, None, None, None, True, None, 0)]
    t = spark.createDataFrame(rows, "export_id string, conversation string, seq int, source string, sender string, media_type string, resolved struct<year: int, month: int, day: int, hour: int, minute: int, second: int>, content string, media_ids string, title string, is_sender boolean, links array<string>, created_epoch_ms long")
    dirs = spark.createDataFrame([("e", 'c"1', "c_1"), ("e", "d", "d")], "export_id string, conversation string, dir string")
    whole = {f: {r.conversation: r.document for r in timeline.documents(t, f).collect()} for f in timeline.FORMATS}
    for fmt, ext in timeline.FORMATS.items():
        timeline.write_transcripts(t, str(tmp_path), fmt, dirs=dirs)
        files = {str(p.relative_to(tmp_path)): p.read_bytes().decode() for p in tmp_path.rglob(f"*.{ext}")}
        assert sorted(files) == [f"e/c_1/history.{ext}", f"e/d/history.{ext}"]
        for folder, conversation in (("c_1", 'c"1'), ("d", "d")):
            got, want = files[f"e/{folder}/history.{ext}"], whole[fmt][conversation]
            if fmt in ("csv", "text"):
                assert got == want
            elif fmt == "json":
                assert json.loads(got) == json.loads(want)
            else:
                assert got.replace("</article>\n<article>", "</article><article>") == want + "\n" * (got.endswith("\n") and not want.endswith("\n"))
    kept = (tmp_path / "e/d/history.json").stat().st_mtime_ns
    timeline.write_transcripts(t.filter("conversation = 'd'"), str(tmp_path), "json", dirs=dirs)
    assert (tmp_path / "e/d/history.json").stat().st_mtime_ns == kept and (tmp_path / "e/c_1/history.json").exists()
    same = t.withColumn("conversation", F.when(F.col("conversation") == "d", "c 1").otherwise("c/1"))
    with pytest.raises(ValueError, match="share a folder"):
        timeline.write_transcripts(same, str(tmp_path / "x"), "json")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", 1, "one"), ("b/y.txt", 1, "two")], "path string, place int, piece string")
    bad = rows.withColumn("piece", F.when(F.col("path") == "b/y.txt", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="lost"):
        named_files.write_named(bad, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="below the root"):
        named_files.write_named(rows.withColumn("path", F.lit("../x")), str(tmp_path / "out"))
    named_files.write_named(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/b/y.txt").read_text() == "two\n" and not (tmp_path / "out/_staging").exists()


def test_landed_files_are_followed_by_their_record(spark, tmp_path):
    """The stream knows the record's files, one for each task; landed files, more in number, are opened by tasks."""
    root, record, out = str(tmp_path / "in"), f"file://{tmp_path}/record", f"file://{tmp_path}/out"
    sink = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    for file in ("friends.json", "ranking.json"):
        rows = spark.range(60).select(F.format_string(f"mydata~%d/json/{file}", "id").alias("path"), F.explode(F.array(F.lit(1), F.lit(0))).alias("place"), F.col("place").cast("string").alias("piece"))
        named_files.write_named(rows, root, record)
        jobs.ingest(jobs.stream_landed(spark, root, record), sink, str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("export_id", "file", "body", "batch").collect())
    assert got == sorted((str(i), f, "0\n1\n", b) for i in range(60) for b, f in enumerate(("friends.json", "ranking.json")))
    seen = [line for p in (tmp_path / "cp" / "sources").rglob("[0-9]*") if p.is_file() for line in p.read_text().splitlines() if "path" in line]
    assert seen and all("/record/part-" in line for line in seen) and len(seen) <= 8


def test_listing_with_gaps(spark, tmp_path):
    class Locked(named_files.MediaFolders):
        """As where a folder called locked can't be read. A class of its own, which tasks get by value."""

        @staticmethod
        def scan(path):
            if path.endswith("/locked"):
                raise PermissionError(path)
            return named_files._scan(path)

    for f in ("mydata~1/memories/a.jpg", "mydata~1/memories/deep/b.jpg", "mydata~2/x/memories/c.jpg", "mydata~2/locked/memories/d.jpg", "mydata~3/other/e.jpg"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    (tmp_path / "mydata~3/memories").symlink_to(tmp_path / "mydata~1/memories")
    listing, gaps = named_files.media_folders(spark, str(tmp_path), "memories", Locked)
    assert {(r.export_id, r.name, r.length) for r in listing.collect()} == {("1", "a.jpg", 1), ("2", "c.jpg", 1)}
    assert [(r.export_id, r.dir.endswith("mydata~2/locked"), r.kind) for r in gaps.collect()] == [("2", True, "PermissionError")]
    entries = spark.createDataFrame([("1", 0, "2020-01-01", "image"), ("2", 0, "2020-01-01", "image")], "export_id string, entry_index long, day string, kind string")
    media = spark.createDataFrame([], "export_id string, day string, kind string, uuid string")
    assert {(r.export_id, r.reason) for r in reconcile.memory_items(entries, media, gaps).collect()} == {("1", "no_media"), ("2", "scan_incomplete")}
    _, none = named_files.media_folders(spark, str(tmp_path / "absent"), "memories")
    assert [r.kind for r in none.collect()] == ["FileNotFoundError"]


def test_numbers_of_a_wide_group(spark):
    rows = spark.range(5000).selectExpr("if(id % 10 < 7, null, id % 10) AS g", "(id * 7919) % 5003 AS v")
    out = places.numbered(rows, ["g"], [F.col("v").desc()], "k", most=300)
    assert out.columns == ["g", "v", "k"]
    want = rows.selectExpr("g", "v", "row_number() OVER (PARTITION BY g ORDER BY v DESC) AS k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    parts = places.numbered(rows.filter("g is null"), ["g"], [F.col("v")], "k", most=300)
    assert parts.agg(F.max("k")).first()[0] == 3500


def test_digests_of_large_files(spark, tmp_path):
    import hashlib

    for name, n in (("a", 10), ("b", 3_000_000)):
        (tmp_path / name).write_bytes(name.encode() * n)
    got = {r.path: (r.checksum, r.bytes) for r in status.file_digests(spark, str(tmp_path), whole=1000).collect()}
    assert got == {str(tmp_path / name): (hashlib.sha256(name.encode() * n).hexdigest(), n) for name, n in (("a", 10), ("b", 3_000_000))}


def test_versions_follow_one_another(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    items = frame(spark, [item("a"), item("b", "done", output_path="/o", checksum="c", bytes=1)], ITEMS)
    assert status.latest(spark, path) == 0 and status.read_published(spark, path).count() == 0
    status.publish(items, path, 1, "one")
    assert status.latest(spark, path) == 1 and sorted(status.read_published(spark, path).collect(), key=str) == sorted(items.collect(), key=str)
    with pytest.raises(ValueError, match="does not follow"):
        status.publish(items, path, 1, "two")
    # a writer that died half way holds the version: readers don't see it, others fail, the same one comes again
    assert status._claim(spark, f"{path}/version=2/_CLAIM") and status._claim(spark, f"{path}/version=2/_CLAIM.one")
    with pytest.raises(ValueError, match="another writer"):
        status.publish(items, path, 2, "two")
    assert status.latest(spark, path) == 1
    with pytest.raises(ValueError, match="not published"):
        status.read_published(spark, path, 2)
    status.publish(items.limit(1), path, 2, "one")
    assert status.latest(spark, path) == 2 and status.read_published(spark, path).count() == 1 and status.read_published(spark, path, 1).count() == 2


def memories(tmp_path, export, file, entries):
    import json

    f = tmp_path / f"mydata~{export}" / "json" / file
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(json.dumps({"Saved Media": entries} if file.startswith("mem") else {"Friends": entries}))


def test_deliveries_that_land_apart(spark, tmp_path):
    """Files of one delivery in several batches, and a batch that comes again, give what one run gives."""
    uuid = "0a1b2c3d-0000-1111-2222-{:012d}"
    entry = lambda d: {"Date": f"2020-01-{d:02d} 00:00:00 UTC", "Media Type": "Image", "Download Link": f"https://h/{d}"}
    listing = spark.createDataFrame([("1", f"m/memories/2020-01-{d:02d}_{uuid.format(d)}-main.jpg") for d in (1, 2)] + [("2", f"m/memories/2020-01-09_{uuid.format(9)}-main.jpg")], "export_id string, path string")
    gaps = spark.createDataFrame([("2",)], "export_id string")

    def run(name, steps):
        root, out = tmp_path / name, f"file://{tmp_path}/{name}-out"
        for step in steps:
            for args in step:
                memories(root, *args)
            jobs.ingest(jobs.stream_texts(spark, str(root)), jobs.take_deliveries(out, listing, gaps, 5), f"{tmp_path}/{name}-cp").awaitTermination(120)
        return out, sorted(tuple(r) for r in status.read_published(spark, out + "/items").select("export_id", "source_id", "status", "last_error").collect())

    one = ("1", "memories_history.json", [entry(1), entry(3)])
    two = ("2", "memories_history.json", [entry(5)])
    friends = ("1", "friends.json", [])
    _, whole = run("whole", [[one, two, friends]])
    out, apart = run("apart", [[friends, two], [one]])
    assert apart == whole and [(e, s) for e, _, s, _ in whole] == [("1", "pending"), ("1", "pending"), ("2", "source_missing")]
    version = status.latest(spark, out + "/items")
    batch = spark.createDataFrame([("1", "memories_history.json", "{}")], "export_id string, file string, body string")
    jobs.take_deliveries(out, listing, gaps, 5)(batch, version - 1)  # replayed: published already
    assert status.latest(spark, out + "/items") == version


def test_snapshots(spark, tmp_path):
    items = frame(spark, [item("a"), item("b", "done", output_path="/o", checksum="c", bytes=1)], ITEMS)
    status.write_snapshot(items, str(tmp_path), 1)
    back = status.read_snapshot(spark, str(tmp_path), 1, "e")
    assert back.columns == items.columns and sorted(back.collect(), key=str) == sorted(items.collect(), key=str)
    with pytest.raises(ValueError):
        status.read_snapshot(spark, str(tmp_path), 1, "other")
    with pytest.raises(Exception, match="(?i)exist"):
        status.write_snapshot(items, str(tmp_path), 1)


def test_messages_are_made_in_tasks_of_a_fixed_size(spark, tmp_path, monkeypatch):
    """Twice the lines make twice the tasks, so that none of them holds more."""
    monkeypatch.setattr(views, "LINES", 100)
    made = []
    for n in (400, 800):
        d = f"{tmp_path}/{n}"
        spark.range(n).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey")).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
        spark.range(n // 4).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
        messages = views.token_messages(spark, d)
        assert messages.count() == n // 4 and messages.filter("pos = 1").first().media_ids == "b~4 | b~5 | B~6 | b~7"
        made.append(messages.rdd.getNumPartitions())
    assert made == [4, 8]


def test_named_set_is_disjoint(spark):
    ids = lambda *ks: spark.createDataFrame([("e", k) for k in ks], "export_id string, source_id string")
    assert {(r.source_id, r.side) for r in reconcile.named_set(ids("a", "b"), ids("c")).collect()} == {("a", "item"), ("b", "item"), ("c", "gap")}
    with pytest.raises(Exception, match="share an id"):
        reconcile.named_set(ids("a"), ids("a")).collect()


def test_mirror(spark, tmp_path):
    import json

    corpus = spark.createDataFrame([("e", "marielle1.json", '{"username": "marielle", "n": [1, {"note": "home"}]}'), ("e", "marielle2.json", '{"username": "paul"}')], "export_id string, file string, body string")
    out = redact.synthesise(redact.leaves(spark, corpus), "s", 0)
    redact.write_redacted(out, str(tmp_path))
    docs = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "documents" / "export_id=e").glob("*/part-*")}
    assert set(docs) == {"file=xxxxxxxxx.json", "file=xxxxxxxxx-2.json"} and docs["file=xxxxxxxxx.json"]["n"][1]["note"].startswith("redacted-")
    listing = {(r.file, r.leaves) for r in spark.read.parquet(f"{tmp_path}/listing").collect()}
    assert listing == {("xxxxxxxxx.json", 3), ("xxxxxxxxx-2.json", 1)} and spark.read.parquet(f"{tmp_path}/report").count() > 0
    assert "marielle" not in str(list(tmp_path.rglob("*"))) and "paul" not in str(docs)


def test_json_that_goes_on_is_no_json(spark):
    from heronry.functions import expr as x

    given = ['{"a": 1}', '{"a": 1}}', '{"a": 1} {"b": 2}', '{"a": 1},{}', '{"a": 1},null', "7", " [1] ", "", None, '{"a": 1, "a": 2}']
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "b string").select(F.to_json(x.parse_strict(F.col("b"))).alias("j")).collect()]
    assert got == ['{"a":1}', None, None, None, None, "7", "[1]", None, None, None]


def test_readers_of_sections_need_no_shuffle_and_a_small_plan(spark, capsys):
    texts = spark.createDataFrame([("a", "friends.json", "{}"), ("a", "account.json", "[]"), ("b", "other.json", "{}"), (None, "friends.json", "{}"), ("c", "ranking.json", None)], "export_id string, file string, body string")
    sections, errors = exports.read_sections(texts)
    sections.filter("state <> 'absent'").select("export_id", "state").explain(True)
    plan_text = capsys.readouterr().out
    assert "Exchange" not in plan_text and len(plan_text) < 400_000
    assert sorted((r.export_id, r.file, r.state) for r in sections.filter("state <> 'absent'").collect()) == [("a", "account.json", "broken"), ("a", "friends.json", "loaded"), ("c", "ranking.json", "broken")]
    assert sections.groupBy("export_id").count().filter("count <> 20").count() == 0 and sections.count() == 80
    assert sorted((r.file, r.kind) for r in errors.collect()) == [("account.json", "shape"), ("ranking.json", "io")]


def test_ranges_follow_from_the_rows_and_not_from_the_bound_alone(spark, monkeypatch):
    seen = {}

    def cut(rows, name, real=places.cut):
        out = real(rows, name)
        if name == "ranges":
            seen["ranges"] = out.select("__part").distinct().count()
        return out

    monkeypatch.setattr(places, "cut", cut)
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 4000).alias("v"))
    out = places.numbered(rows, ["g"], [F.col("v")], "k", most=5)
    assert 1 < seen["ranges"] <= int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    want = rows.toPandas().sort_values(["g", "v"])
    want["k"] = want.groupby("g").cumcount() + 1
    assert sorted(map(tuple, out.select("g", "v", "k").collect())) == sorted(map(tuple, want[["g", "v", "k"]].values.tolist()))


def test_source_state_looks_at_parts_once(spark, capsys):
    parts = spark.createDataFrame([("x", [1, 4], [2]), ("y", [], [1])], "id string, zips array<long>, folders array<long>")
    out = reports.source_state(parts, spark.createDataFrame([("x",), ("z",)], "export_id string"))
    out.explain()
    assert capsys.readouterr().out.count("Join") == 1
    assert sorted((r.export_id, r.state, r.zips, r.missing) for r in out.collect()) == [("x", "one", 2, [3]), ("z", "none", None, None)]


def test_copies_are_numbered_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(places, "cut", lambda rows, name, real=places.cut: names.append(name) or real(rows, name))
    rows = [("e", "/o", i, 0, s, "jpg") for i, s in enumerate(["a", "A", "a", "b_2", "b", "b"])]
    out = plan.allocate_copies(spark.createDataFrame(rows, "export_id string, dir string, seq long, part int, stem string, ext string"))
    assert [r.copy for r in out.orderBy("seq").collect()] == ["a.jpg", "A_2.jpg", "a_3.jpg", "b_2.jpg", "b.jpg", "b_3.jpg"]
    assert "numbers" not in names


def test_entries_are_made_by_code_that_the_jvm_compiles(spark):
    texts = spark.createDataFrame([("a", "memories_history.json", "{}")], "export_id string, file string, body string")
    rows = exports.memory_entries(exports.read_sections(texts)[0])
    rows = rows.select("export_id", "entry_index", "day", "kind", "lat", "lon", "place", "url", F.col("error.kind").alias("error"))
    code = rows._jdf.queryExecution().debug().codegenToSeq()
    # methods of over 8000 bytes are interpreted
    assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


def test_the_schema_of_a_whole_file_judges_as_the_walk_does(spark):
    rng = random.Random(3)
    odd = ["null", "1", "-1", "2.5", "1e3", "true", '"a"', '"null"', "[]", "[null]", "[1, 2.5]", "{}", '{"a": null}', "99999999999999999999"]

    def some(kind, depth=0):
        if rng.random() < 0.04:
            return rng.choice(odd)
        if hasattr(kind, "fields"):
            keys = [f for f in kind if rng.random() < 0.7]
            more = [f'"{k}": {rng.choice(odd)}' for k in ("New", "a`b", "Date: STRING, x", "") if rng.random() < 0.03 and k not in kind.names]
            return "{" + ", ".join([f'"{f.name}": {some(f.dataType)}' for f in keys] + more) + "}"
        if hasattr(kind, "elementType"):
            return "[" + ", ".join(some(kind.elementType) for _ in range(rng.randrange(3))) + "]"
        if hasattr(kind, "valueType"):
            return "{" + ", ".join(f'"{k}": {some(kind.valueType)}' for k in "xyz"[: rng.randrange(3)]) + "}"
        return {"string": '"s"', "bigint": "3", "double": rng.choice(["3", "2.5"]), "boolean": "true"}.get(kind.simpleString(), rng.choice(odd))

    rows = [(f"{f}{i}", f, some(kind)) for f, kind in exports.SCHEMAS.items() for i in range(120)]
    texts = spark.createDataFrame(rows, "export_id string, file string, body string")
    walked = {r.export_id for r in exports.misshapen(texts).select("export_id").collect()}
    sections, errors = exports.read_sections(texts)
    assert {r.export_id for r in errors.filter("kind = 'shape'").collect()} == walked
    by_file = {f: sum(e.startswith(f) for e in walked) for f in exports.SCHEMAS}
    assert all(0 < n < 120 for n in by_file.values()), by_file
    # a file that fits is not walked
    plain = exports._plain_text(exports.SCHEMAS["memories_history.json"])
    fits = '{"Saved Media": [{"Date": "d", "Media Type": "x", "Media Download Url": ""}, {}], "Saved Media 2": []}'
    told = spark.createDataFrame([(fits.replace(', "Saved Media 2": []', ""),), (fits,), ('{"Saved Media": [{"Date": 1}]}',), ('{"Saved Media": []}',)], "b string").select(F.schema_of_variant(F.parse_json("b")).rlike(f"^{plain}\\z").alias("t"))
    assert [r.t for r in told.collect()] == [True, False, False, True]


def test_written_transcripts_are_read_by_their_record(spark, tmp_path):
    schema = "export_id string, conversation string, source string, seq int, sender string, is_sender boolean, media_type string, resolved struct<year: int, month: int, day: int, hour: int, minute: int, second: int>, content string, media_ids string, title string"
    rows = spark.createDataFrame([("e 1", c, "chat", n, "u", True, "TEXT", None, f"{c}é{n}", None, None) for c in ("a", "b%20") for n in (1, 2)], schema)
    root, record = str(tmp_path / "out"), str(tmp_path / "record")
    timeline.write_transcripts(rows, root, "csv", record=record)
    got = {r.path: r.body for r in named_files.read_landed(spark.read.text(record), root).collect()}
    assert got == {f"e 1/{d}/history.csv": (tmp_path / "out" / "e 1" / d / "history.csv").read_text() for d in ("a", "b_20")}
    assert all(len(body.splitlines()) == 3 for body in got.values())


def test_no_scan_lists_the_written_transcripts(spark):
    from heronry.plans import registry

    files = registry.QUERIES["written_transcripts"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if f.endswith("history.csv")]


def test_landed_files_make_room(spark, monkeypatch):
    """A round of landed_items has some of its files on disk at a time, and none of them, nor a table between its steps,
    when they are taken in."""
    from pathlib import Path

    from heronry.plans import deliveries, registry

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, held, ingest = set(shared.iterdir()), [], jobs.ingest
    new = lambda: set(shared.iterdir()) - before
    files = lambda: [f for d in new() if d.name.startswith("heronry-landing-") for f in d.rglob("*.json")]

    def counted(*args):
        held.append(len(files()))
        return ingest(*args)

    monkeypatch.setattr(jobs, "ingest", counted)
    monkeypatch.setattr(deliveries, "LANDED_AT_ONCE", 80, raising=False)
    out = registry.QUERIES["landed_items"](spark, "/root/testdata/sf0.001")
    assert sum(held) == 2 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey").distinct().count()
    assert max(held) < 110 and not files()
    assert {d.name.split("-")[1] for d in new()} == {"landing", "status", "progress", "record"}
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_landed_files_are_removed_one_by_one(spark, tmp_path):
    root, record, seen = str(tmp_path / "in"), f"file://{tmp_path}/record", []
    rows = spark.range(40).select(F.format_string("mydata~%d/json/a.json", "id").alias("path"), F.explode(F.array(F.lit(1), F.lit(0))).alias("place"), F.col("place").cast("string").alias("piece"))
    other = tmp_path / "in" / "mydata~7" / "other.json"
    other.parent.mkdir(parents=True)
    other.write_text("kept")
    take = lambda: seen.append({str(p.relative_to(root)): p.read_text() for p in (tmp_path / "in").rglob("a.json")})
    named_files.land(rows, root, record, 10, take)
    assert len(seen) == 4 and all(0 < len(s) < 25 for s in seen)
    assert {k: v for s in seen for k, v in s.items()} == {f"mydata~{i}/json/a.json": "0\n1\n" for i in range(40)} and sum(map(len, seen)) == 40
    assert [p for p in (tmp_path / "in").rglob("*")] == [other.parent, other] and other.read_text() == "kept"
    gone = spark.read.text(record)
    named_files.remove_named(gone, root)  # a task that comes again
    assert gone.distinct().count() == 40 and other.exists()
    with pytest.raises(Exception, match="below the root"):
        named_files.remove_named(spark.createDataFrame([("../in/mydata~7/other.json",)], "value string"), root)


def test_batches_of_one_version(spark, tmp_path):
    """Batches that are kept first and published together give what they give one by one; later batches come first."""
    body = lambda *days: '{"Saved Media": [' + ", ".join(f'{{"Date": "2020-01-{d:02d} 00:00:00 UTC", "Media Type": "Image", "Download Link": "https://h/{d}"}}' for d in days) + "]}"
    listing = spark.createDataFrame([(e, f"m/memories/2020-01-01_0a1b2c3d-0000-1111-2222-{int(e):012d}-main.jpg") for e in "123"], "export_id string, path string")
    gaps = spark.createDataFrame([("2",)], "export_id string")
    rows = [[("1", body(1), 0), ("2", body(9), 0)], [("3", body(1, 5), 1)], [("1", body(1, 3), 2)]]
    batches = [spark.createDataFrame([(e, "memories_history.json", b) for e, b, _ in r], "export_id string, file string, body string") for r in rows]
    state = lambda out: sorted(tuple(r) for r in status.read_published(spark, out + "/items").select("export_id", "source_id", "status", "last_error").collect())
    apart, whole = f"file://{tmp_path}/apart", f"file://{tmp_path}/whole"
    for i, batch in enumerate(batches):
        jobs.take_deliveries(apart, listing, gaps, 5)(batch, i)
        jobs.keep_texts(whole, 1 + i // 2)(batch, i)
    for version in (1, 2, 2):
        jobs.publish_deliveries(spark, whole, version, listing, gaps, 5)
    assert status.latest(spark, whole + "/items") == 2 and status.latest(spark, apart + "/items") == 3
    assert state(whole) == state(apart) and len(state(whole)) == 5
