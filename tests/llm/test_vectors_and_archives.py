import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import multi_index, warc


def test_nearest_recall(spark):
    x = np.random.default_rng(0).normal(size=(1500, 24))
    x[:700] += 3 * np.random.default_rng(1).normal(size=(7, 24)).repeat(100, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = multi_index.report(df).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        assert sorted(got[q]) == list(range(1, 21))
        found = [got[q][k] for k in range(1, 21)]
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for v, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hit += len(best & {v for v, _ in found})
    assert hit >= 0.9 * 20 * 75


def test_pigeonhole_misses_nothing():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 26))
    bits[:500] = bits[0] ^ (rng.random((500, 26)) < 0.15)
    for tables in (1, 3, 5):
        edges = [26 * t // tables for t in range(tables + 1)]
        codes = np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(edges, edges[1:])], 1)
        for radius in (0, 1, 3, 8, 26):
            depths = multi_index.thresholds(radius, tables)
            for q in range(20):
                near, _ = multi_index.retrieved(codes, codes[q], depths)
                assert near[(bits != bits[q]).sum(1) <= radius].all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_share_on_the_tables(spark, sf):
    """Every query of the table against brute force, and how many rows the tables retrieve for it."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in multi_index.report(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == ids[asked].tolist()
    index = multi_index.fit(x, np.linalg.norm(x, axis=1).max(), 20)
    codes, own = index.codes(x), index.codes(x, query=True)
    hit, share = 0, []
    for i in asked.tolist():
        score = (x * x[i]).sum(1)
        score[i] = -np.inf
        mine = sorted(got[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(s == score[np.flatnonzero(ids == v)[0]] for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
        share.append(multi_index.retrieved(codes, own[i], multi_index.thresholds(index.radius, index.tables))[0].mean())
    print(sf, "recall", hit / (20 * len(asked)), "share retrieved", np.mean(share), "radius", index.radius)
    assert hit >= 0.9 * 20 * len(asked) and np.mean(share) < 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 5.0]), (None, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [inf, 1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.report(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 1.0), (0, 5, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 2, 1.0), (20, 5, 3, 0.0)]
    assert multi_index.report(df.limit(0)).count() == 0


def test_repeated_vectors_are_rows_of_their_own(spark):
    """Candidates that repeat a row count as often as they occur; so do queries, which get an answer each."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.report(df).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (0, 4, 1, 0.5), (0, 5, 20, 0.0), (0, 6, 20, 0.0)]
    assert sum(g[0] == 20 for g in got) == 3 * 4


def test_wide_vectors(spark):
    x = np.random.default_rng(5).normal(size=(300, 700))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in multi_index.report(df).collect()}
    hit = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += sum((q, v) in got for v in np.argsort(-score)[:20].tolist())
    assert hit >= 0.9 * 20 * 15


PAGES = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, None, None), (None, "u", "x" * 1500), (4, "u", "é" * 40000), (4, "u", "é" * 40000), (5, "a b\r\n", "WARC/1.1\r\n\r\n\r\n\r\n" * 3), (6, "u", "s"), (7, "u", "s"), (8, "u", "")]


def test_archives(spark):
    import hashlib

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    out = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_report(spark, df).collect())
    want = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        again = i in (1, None)
        want.append((i or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 2 if again else 0))
    assert out == sorted(want)
    assert warc.archive_report(spark, df.limit(0)).count() == 0


def test_payloads_come_back_byte_for_byte(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").filter("page_id is not null")
    path = f"file://{tmp_path}/warc"
    warc.write_warc(warc.mark_revisits(df), path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    assert records.filter("record_type = 'continuation'").count() > 100
    back = sorted((r.page_id, bytes(r.payload)) for r in warc.read_payloads(spark, path).filter("record_type = 'response'").collect())
    assert back == sorted((i, (h or "").encode()) for i, _, h in PAGES if i not in (None, 1))
    assert records.filter("segment is null").count() + warc.reassemble(records).count() == sum(i is not None for i, _, _ in PAGES)
    revisit = records.filter("record_type = 'revisit'").first()
    assert (revisit.page_id, revisit.refers_to) == (1, 2)
    torn = records.filter("not (record_type = 'continuation' and segment = 3)")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(torn).collect()
    with pytest.raises(ValueError, match="payload"):
        warc.mark_revisits(df.withColumn("payload", F.lit(1)))


def test_a_revisit_without_its_response_fails(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "u", "x" * 1500), (2, "u", "x" * 1500)], "page_id long, url string, html string")
    whole = warc.read_payloads
    monkeypatch.setattr(warc, "read_payloads", lambda s, p: whole(s, p).filter("record_type = 'revisit'"))
    with pytest.raises(Exception, match="no response for the revisit of page 1"):
        warc.archive_report(spark, df).collect()


def test_chunks():
    for data in (b"", b"a", b"\r\n0\r\n\r\n" * 2000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(b"abcdef", 3)[:-6])
