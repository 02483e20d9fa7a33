"""The pipeline's stages against plain versions, and the registered operators against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from heronry.llm import common, cotraining, registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_names():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in registry.QUERIES[name](spark, DIR).collect())


def test_stages(spark):
    docs = common.documents(spark, DIR)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, seen[-1], DIR), name)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        seen.append(out)
    raw, good, lined, single, mixed, coded = [[r.asDict() for r in d.collect()] for d in seen]
    kept = {r.doc_id for r in cotraining.report(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect() if r.kept}
    assert {r["doc_id"] for r in good} == kept and 0 < len(good) < len(raw)
    texts = {r["doc_id"]: r["text"] for r in good}
    for r in lined:
        left = Counter(texts[r["doc_id"]].split("\n"))
        left.subtract(r["text"].split("\n"))
        assert min(left.values()) >= 0
    every = [frozenset(x.lower().split()) for r in lined for x in r["text"].split("\n") if x.split()]
    assert len(every) == len(set(every))
    assert {r["doc_id"] for r in single} <= {r["doc_id"] for r in lined}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single} and max(Counter(r["doc_id"] for r in mixed).values()) <= 4
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed)


def test_near_duplicates_reach_the_similarity(spark):
    import random
    import re

    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice((30, 120, 300)))]
        for k in range(r.randint(1, 5)):
            words = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 60)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            cut = r.randrange(len(words))
            texts.append(" ".join(words[:cut]) + ("\n" if k % 2 else " ") + " ".join(words[cut:]))
    rows = list(enumerate(texts)) + [(None, "only here in this place"), (5, texts[20])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                far += a != sets[j]
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, t) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0, t or ""))
    want = sorted(min(g) for g in groups.values())
    got = corpus_pipeline.near_duplicates(spark, docs, DIR).collect()
    assert far > 40 and sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in got) == want
