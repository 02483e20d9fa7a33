"""Operators over tables in which one row occurs thousands of times."""

import hashlib

import pytest
from pyspark.sql import functions as F

from heronry.llm import line_dedup, suffixes
from tests.llm.test_text_operators import frame

COPIES = 10_000


@pytest.mark.parametrize("doc_id", [7, None])
def test_a_row_repeated_ten_thousand_times_in_op10(spark, doc_id):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1500))
    rows = frame(spark, [(doc_id, text), (9, "x" + text[:500]), (10, "no repeats here")])
    copies = rows.filter(rows.text.startswith(text)).withColumn("copy", F.explode(F.sequence(F.lit(2), F.lit(COPIES))))
    got = suffixes.report(rows.unionByName(copies.select(rows.columns)))
    counts = {tuple(r)[:-1]: r["count"] for r in got.groupBy(*got.columns).count().collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert counts == {
        (doc_id, 1500, 1500, 1, empty): COPIES,
        (9, 501, 500, 1, hashlib.sha256(b"x").hexdigest()): 1,
        (10, 15, 0, 0, hashlib.sha256(b"no repeats here").hexdigest()): 1,
    }


@pytest.mark.parametrize("doc_id", [2, None])
def test_a_row_repeated_ten_thousand_times_in_op2(spark, doc_id):
    text = "\n".join([f"line number {i} of the text" for i in range(20)] + ["one more line", "one more line"])
    rows = frame(spark, [(5, "one more line\nanother line"), (doc_id, text)])
    copies = rows.filter("doc_id is null or doc_id = 2").withColumn("copy", F.explode(F.sequence(F.lit(2), F.lit(COPIES))))
    got = line_dedup.report(rows.unionByName(copies.select(rows.columns))).select("doc_id", "n_lines", "n_removed", "removed_lines")
    counts = {(r.doc_id, r.n_lines, r.n_removed, tuple(r.removed_lines)): r["count"] for r in got.groupBy(*got.columns).count().collect()}
    assert counts == {(doc_id, 22, 1, (21,)): COPIES, (5, 2, 1, (0,)): 1}


def test_the_same_row_twice_is_one_document_of_lines(spark):
    rows = [(1, "alpha beta gamma\ndelta epsilon"), (2, "alpha beta gamma\nzeta eta theta"), (2, "alpha beta gamma\nzeta eta theta")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, list(r.removed_lines)) for r in line_dedup.report(frame(spark, rows)).collect())
    assert got == [(1, 2, 0, []), (2, 2, 1, [0]), (2, 2, 1, [0])]
