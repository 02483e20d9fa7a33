import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.llm import anchors

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        twice = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if right(k, m[0])] for k, p in PATTERNS.items()}


TEXTS = [
    "", "a@b.c@d.e", "a@b@c.d", "x@y..z", "@a.b", "a.b+c%d@e-f.g.h.", "1.2.3.4.5.6.7.8.9", "1.2.3 4.5.6.256", "0001.002.3.4", "1.2.3.4444", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111 11111111 1", "41111111111111112",
    "+1 (555) 123-4567", "+1", "+12", "+1-2", "++1 555 123 4567+49 30 1234567", "+1 555 123 4567 8901 2345", "é" * 5 + "x@y.zz" + "İ" * 3 + "+49 30 123 45 67", "1 2 3 4 5 6 7 8 9 0 1 2 8", "٣٣٣٣٣٣٣٣٣٣٣٣", "a@b.c\n1.1.1.1\t5555555555554444",
]


def test_base_equals_the_grammars():
    for t in TEXTS:
        got = anchors.find(t)
        assert {k: got[k] for k in PATTERNS} == plain(t), t


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aZ0123459@@..+ -()%é\n_"), max_size=60))
def test_base_equals_the_grammars_on_random_texts(t):
    got = anchors.find(t)
    assert {k: got[k] for k in PATTERNS} == plain(t)


def test_added_kinds():
    found = lambda t: {k: [t[a:b] for a, b in s] for k, s in anchors.find(t).items() if s}
    assert found("see HTTPS://user@example.org/a?b=1. Or not://") == {"address": ["HTTPS://user@example.org/a?b=1"]} | {"email": ["user@example.org"]} or found("see HTTPS://example.org/a?b=1. Or not://") == {"address": ["HTTPS://example.org/a?b=1"]}
    assert found("mailto:a@b.org") == {"email": ["a@b.org"]}
    assert found("call tel:0301234567 now") == {"address": ["tel:0301234567"]}
    assert found("IBAN: DE89 3704 0044 0532 0130 00 paid") == {"account": ["DE89 3704 0044 0532 0130 00"]}
    assert found("IBAN: DE88370400440532013000") == {}
    assert found("Account no. 12-3456/B and accounts 1234, account of 2021x") == {"account": ["12-3456/B"]}
    assert found('token = "24be64439e3e49cf46b2d7c90f3602a3"') == {"account": ["24be64439e3e49cf46b2d7c90f3602a3"]}
    assert found("a token of thanks, the account was closed, pass the license") == {}


def test_long_texts_take_linear_time():
    for t in ("1" * 400_000, "1." * 200_000, "a" * 400_000 + "@", "+1" * 200_000, "token" * 80_000, "a@" * 200_000, "://" * 130_000, "1 " * 200_000, "+1 (" * 100_000):
        assert sum(map(len, anchors.find(t).values())) <= len(t)


def test_report(spark):
    texts = [None, "", *TEXTS, "IBAN: DE89370400440532013000 " * 3, "x " * 300_000 + "a@b.cc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cc"), (3, "a@b.c@d.e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit(1)).withColumn("spans", F.lit("taken"))
    got = sorted((tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in anchors.report(df).collect()), key=repr)
    want = []
    for i, t in rows:
        p = plain(t or "")
        spans = sorted((a, list(PATTERNS).index(k), b) for k in p for a, b in p[k])
        text = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(len(p[k]) for k in PATTERNS), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert anchors.report(df.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in anchors.masked_documents(df).collect()}
    assert masked[None] == "<email>" and masked[0] is None and masked[3] == "<email>@d.e" and masked[len(texts) - 2] == "IBAN: <account> " * 3
    assert set(anchors.with_personal_data(df).columns) == {*df.columns, "personal"}
