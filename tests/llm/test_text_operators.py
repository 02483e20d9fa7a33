import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heronry.llm import bpe, cotraining, language, line_dedup, line_rules, mixing, simhash, suffixes, textvec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def frame(spark, rows, extra=()):
    """Documents of (doc_id, text) with other columns, one of which clashes with names that operators use."""
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("mix", F.lit(1)).withColumn("rules", F.lit("x"))


TRICKY = [(1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "a"), (5, "A b  c\nd"), (5, "A b  c\nd"), (None, "é ü 中 x"), (6, "x " * 5000), (7, "a b c\x1cd")]


# ---- words ----


def test_words_and_lines(spark):
    import pyarrow as pa

    texts = ["a b", "", None, "é\n\nx y\n", "\n", "z"]
    raw, offsets = textvec.column_bytes(pa.array(texts))
    starts, ends, doc = textvec.words(raw, offsets)
    assert [(d, raw[a:b].tobytes().decode()) for d, a, b in zip(doc, starts, ends)] == [(0, "a"), (0, "b"), (3, "é"), (3, "x"), (3, "y"), (5, "z")]
    a, b, d = textvec.lines(raw, offsets)
    assert [(i, raw[s:e].tobytes().decode()) for i, s, e in zip(d, a, b)] == [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]


# ---- op8 ----


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    again = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_line_rules_counts(spark):
    r = random.Random(1)
    rows = TRICKY + [(100 + i, "".join(r.choice(["a ", "b ", "c\n", "# ", "é", " "]) for _ in range(r.randint(0, 120)))) for i in range(60)]
    out = line_rules.quality_report(frame(spark, rows)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((i if i is not None else -1, *plain_counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in out)


def test_line_rules_verdicts(spark):
    good = "\n".join(f"This is sentence number {i} of a fine text with different words {i * 7}." for i in range(12))
    menu = good.split("\n")[0] + "\n" + "\n".join("Home | About | Contact | Login | News | Sport | Shop | Help | Terms" for _ in range(1)) + "\n" + "\n".join(f"Item{i} | More{i} | Buy{i} | Now{i}" for i in range(30))
    shout = " ".join(f"WORD{i}!!" for i in range(60)) + "."
    rows = [(1, good), (2, menu), (3, shout), (4, good + "\nAll rights reserved.")]
    out = {r.doc_id: r for r in line_rules.clean_documents(frame(spark, rows), name="judged").select("doc_id", "judged.*").collect()}
    with pytest.raises(ValueError, match="rules"):
        line_rules.clean_documents(frame(spark, rows))
    assert [out[i].kept for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert out[4].clean_text == good and out[1].clean_text == good


def plain_shared(rows):
    """Numbers of the lines of each row that many different documents of its source share, by brute force."""
    form = lambda line: re.sub("[0-9]", "0", lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)))
    texts, lines = defaultdict(set), defaultdict(set)
    for _, t, source in rows:
        mine = [form(line) for line in (t or "").split("\n") if WORD.search(line)]
        if mine:
            main = max(mine, key=lambda x: len(x.encode()))
            texts[source].add(main)
            for x in mine:
                lines[source, x].add(main)
    good = {k for k, docs in lines.items() if len(docs) >= 10 and 100 * len(docs) >= len(texts[k[0]]) and len(WORD.findall(k[1])) <= 40}
    return [[i for i, line in enumerate((t or "").split("\n")) if (source, form(line)) in good] for _, t, source in rows]


def test_lines_that_a_source_repeats_are_boilerplate(spark):
    r = random.Random(3)
    fine = lambda: "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "." for n in (r.randint(9, 14), 9, 60, 11))
    foot = "Story {} was brought to you by the people of our small town."
    long = " ".join(f"word{i}x" for i in range(45)) + "."
    rows = [(i, fine() + "\n  " + foot.format(i) + "\n" + long, "a") for i in range(25)]
    rows += [(100 + i, fine() + "\n" + foot.format(i), "b") for i in range(9)]  # too few of b
    copied = fine()
    rows += [(200 + i, copied + f"\nA line {i} of the copy that differs in its end only.", "c") for i in range(40)]  # one document
    rows += [(300 + i, fine() + "\nThis page of the null source has been seen by many people.", None) for i in range(12)]
    rows += [(400, fine() + "\n" + foot.format(7), "d"), (1, rows[1][1], "a"), (500, None, "a"), (501, "", None), (502, "\n\n", "b")]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    docs = docs.withColumn("row", F.lit(1)).withColumn("m", F.lit("x")).withColumn("h", F.lit(2)).withColumn("key", F.lit(3))
    out = line_rules.clean_documents(docs)
    assert out.columns == [*docs.columns, "rules"]
    got = Counter((x.doc_id, x.text, x.source, x.rules.n_failed_lines, x.rules.clean_text) for x in out.collect())
    want = Counter()
    for (i, t, s), gone in zip(rows, plain_shared(rows)):
        want[i, t, s, len(gone), t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)] += 1
    assert got == want
    assert sum(n * k[3] for k, n in got.items()) == 26 + 12  # feet of a and the line of the null source, nothing else
    report = {x.doc_id: x for x in line_rules.quality_report(docs).collect()}
    assert all(report[i].n_failed_lines == n for (i, _, _, n, _) in got)
    assert report[3].lost_chars == len("".join(WORD.findall(foot.format(3))))


# ---- op3 ----


def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), s) for s, n in (("a", 50), ("b", 10), ("c", 200), (None, 20)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_report(docs, rows_per_range=5).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
    total, cap = sum(size.values()), {s: 3 * n for s, n in size.items()}
    weight, target, free = {"a": 5, "b": 2, "c": 1, None: 5}, {}, set(size)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        free -= over
    target |= share
    assert sorted({(r.source_size, round(r.target, 6)) for r in out}) == sorted((size[s], round(float(target[s]), 6)) for s in size)
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
    assert all(abs(taken[size[s]] - target[s]) < 1 for s in size)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_report(docs.repartition(7), rows_per_range=50).collect()))


def test_mixing_edges(spark):
    docs = frame(spark, TRICKY)
    assert mixing.mix_report(docs).count() == len(TRICKY) and mixing.mix_report(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.mix for r in mixed.select("mix").collect()} == {1}
    with pytest.raises(ValueError, match="mix"):
        mixing.mix_sources(docs)


# ---- op5 ----


def plain_fingerprint(t, width=4):
    w = WORD.findall(lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + width]).encode(), 42) for j in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    from itertools import combinations

    masks = simhash.covering_masks(3, 20)
    assert len(masks) == 15 and all(any(not any(m >> i & 1 for i in c) for m in masks) for c in combinations(range(20), 3))


def test_simhash_components(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = list(TRICKY)
    for g in range(25):
        base = [r.choice(words) for _ in range(120)]
        for k in range(r.randint(1, 5)):
            text = list(base)
            for _ in range(k):
                text[r.randrange(120)] = r.choice(words)
            rows.append((1000 + 10 * g + k, " ".join(text)))
    out = simhash.report(frame(spark, rows)).collect()
    prints = {(i, plain_fingerprint(t)) for i, t in rows}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in out} == prints
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert all(r.component_id == least.get(find(int(r.fingerprint, 16))) for r in out)
    kept = simhash.keep_one(frame(spark, rows), radius=4, width=4).collect()
    assert len(kept) == len({find(f) for f in fps})


def test_crowded_buckets_are_masked_again(spark):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << (i * 7 + 3) % 64) for i in range(64)} | {(base * k) & (2**64 - 1) for k in range(3, 40)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    a = simhash.components(simhash.fingerprint_links(df, 4, 100)).collect()
    b = simhash.components(simhash.fingerprint_links(df, 4)).collect()
    assert sorted(a) == sorted(b) and len(a) >= 100


# ---- op6 ----


def test_language_families(spark):
    r = random.Random(4)
    bits = {"en": ["the", "ing", "th", "wh"], "de": ["sch", "ein", "ung", "ich"], "fr": ["eau", "ou", "ez", "que"], "es": ["ción", "ado", "ll", "os"]}
    text = lambda lang: " ".join("".join(r.choice(bits[lang]) for _ in range(r.randint(1, 3))) for _ in range(40))
    rows = [(i, text(lang), lang, None, None) for i, lang in enumerate(list(bits) * 60)] + [(900, None, "en", None, None), (901, "12 34 !", "en", None, None), (None, text("de"), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in language.language_report(docs, max_rows=200).collect()}
    import zlib

    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    held = [i for i in range(240) if out[i].held_out]
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0 and out[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    bare = language.language_report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in bare.collect()} == {"und"}


def test_languages_of_a_family_vote_by_pairs(spark):
    r = random.Random(5)
    share = {"da": 0.97, "no": 0.5, "sv": 0.03}
    text = lambda lang: " ".join("ddd" if r.random() < share[lang] else "sss" for _ in range(80))
    rows = [(i, text(lang), lang, None, None) for i, lang in enumerate(list(share) * 60)]
    out = {x.doc_id: x for x in language.language_report(spark.createDataFrame(rows, DOCS), max_rows=200).collect()}
    # the one between the others is no half space against both, but is one against each
    assert sum(out[i].lang_pred == rows[i][2] for i in out) >= 0.97 * len(out)
    best, total = language._vote(np.array([[1.0, -5.0, 0.1], [3.0, -1.0, 2.0], [-1.0, -1.0, -1.0]]), 3)
    # pairs ab, ac, bc: each one wins once in the first two rows
    assert best.tolist() == [2, 0, 2] and total[1].tolist() == [1.0, -0.5, -0.5]


# ---- op7 ----


def test_the_suffix_automaton_finds_every_word_that_ends_a_prefix():
    draw = random.Random(9)
    for letters in ("ab", "abc", "aé日"):
        words = list({"".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(25)})
        automaton = bpe.SuffixAutomaton(words)
        parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i, len(w) + 1)}
        # a state stands for substrings with the same ends in the same words
        ends = {p: frozenset((k, i) for k, w in enumerate(words) for i in range(len(w) + 1) if w[:i].endswith(p)) for p in parts}
        assert len(automaton.go) == len(set(ends.values()))
        for _ in range(60):
            text = "".join(draw.choice(letters + "x") for _ in range(draw.randint(0, 14)))
            for end, state in enumerate(automaton.endings(text), 1):
                found = []
                while state:
                    assert automaton.size[state] == len(words[automaton.word[state]])
                    found.append(words[automaton.word[state]])
                    state = automaton.above[state]
                assert found == sorted((w for w in words if text[:end].endswith(w)), key=len, reverse=True)
    empty = bpe.SuffixAutomaton([])
    assert empty.endings("ab") == [0, 0]


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.tokenizer(path)
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzTHEING '’sé ÉßñΣσςİ́ͅe½²Ⅷ٣中文字😀👍🏽\x85\xa0\x1c\x1f \t\n.,!?|$#%&*-_()<>0123"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["don't I'LL we've <|endoftext|>hello<|startoftext|>", "<|endoftext", "a" * 500, "!" * 300, "'s'sour", "ÀÉª µ º", "thethe" * 300, ""]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = ours.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert ours.decode(got) == library.decode(want, skip_special_tokens=False)
    out = bpe.digests(bpe.encode_documents(frame(spark, TRICKY), path)).collect()
    for row, (i, t) in zip(out, TRICKY, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (row.doc_id, row.n_tokens, row.ids_sha256) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- op2 ----


def plain_line_dedup(rows):
    def key(i, t, n):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (i is not None, i or 0, h - (1 << 64) if h >> 63 else h, n)

    lines = sorted((key(i, t, n), frozenset(map(lower, WORD.findall(x)))) for i, t in rows for n, x in enumerate((t or "").split("\n")) if WORD.search(x))
    first = {}
    for k, w in lines:
        first.setdefault(w, k)
    links, early = Counter(), {}
    for a in first:
        for b in first:
            if a != b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[a] += 1
                early[a] = min(early.get(a, first[b]), first[b])
    out = defaultdict(lambda: [0, [], 0])
    for k, w in dict.fromkeys(lines):
        r = out[k[:3]]
        r[0] += 1
        r[2] += links[w]
        if k != first[w] or early.get(w, k) < k:
            r[1].append(k[3])
    return sorted(((i, *out[key(i, t, 0)[:3]]) for i, t in rows), key=repr)


def dedup_rows(spark, docs):
    return sorted(((r.doc_id, r.n_lines, list(r.removed_lines), r.n_links) for r in line_dedup.report(docs).collect()), key=repr)


@pytest.mark.parametrize("filtered, block", [(10_000, 2048), (3, 4)])
def test_line_dedup(spark, monkeypatch, filtered, block):
    monkeypatch.setattr(line_dedup, "MAX_FILTERED", filtered)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, t) for i, t in TRICKY if i != 5]
    for i in range(90):
        lines = []
        for _ in range(r.randint(1, 5)):
            base = random.Random(r.randint(0, 14))
            line = [base.choice(words) for _ in range(base.choice([1, 3, 5, 9, 14, 90]))]
            for _ in range(r.randint(0, 2)):
                line[r.randrange(len(line))] = r.choice(words)
            lines.append("  ".join(line))
        rows.append((100 + i, "\n".join(lines)))
    assert dedup_rows(spark, frame(spark, rows)) == plain_line_dedup(rows)


def test_line_removal(spark):
    docs = frame(spark, [(1, "one two three four five six\n\nkeep this"), (2, "Six five four three two one\nnew line"), (3, "keep  THIS"), (4, None)])
    out = {r.doc_id: r.text for r in line_dedup.remove_later_lines(docs).collect()}
    assert out == {1: "one two three four five six\n\nkeep this", 2: "new line", 4: None}
    assert line_dedup.remove_later_lines(docs).columns == docs.columns and line_dedup.report(docs.limit(0)).count() == 0


# ---- op10 ----


def plain_repeats(rows, length):
    count = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def test_merging_runs():
    r = random.Random(1)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 7))]
        got = [(h, t) for h, _, _, t in suffixes.merge_runs([suffixes.front_coded(x) for x in runs])]
        want = sorted(sum(runs, []))
        assert [t for _, t in got] == want
        assert all(h == suffixes._common(want[i - 1] if i else b"", want[i], 0) for i, (h, _) in enumerate(got))


@pytest.mark.parametrize("most", [20_000, 3])
def test_repeated_strings(spark, most):
    r = random.Random(most)
    text = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    base = text("abcd é", 400)
    rows = list(TRICKY)
    for i in range(60):
        a, b = r.randint(0, 380), r.randint(1, 120)
        rows.append((100 + i, text("abcd é", r.randint(0, 60)) + base[a : a + b] + text("xyz", r.randint(0, 60)) + base[b : b + r.randint(0, 90)]))
    rows += [(300, rows[12][1]), (300, rows[12][1]), (None, rows[14][1]), (301, "z" * 300)]
    got = sorted((tuple(r) for r in suffixes.report(frame(spark, rows), length=40, gram=10, max_spans=most).collect()), key=repr)
    assert got == plain_repeats(rows, 40)


# ---- op1 ----


def test_cotraining(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "river", "moves", "under", "stone", "bridges", "quietly", "today"]) + str(r.randint(0, 9)) * (r.random() < 0.02) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "click$$$", "win&&&"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "en", "good.example" if (i % 3 or i % 7 == 0) else "spam.example", 300) for i in range(300)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, None), (900, "", None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 150)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in cotraining.report(docs, labels).collect()}
    assert len(out) == 302 and sum(out[i].kept == bool(i % 3) for i in range(150, 300)) >= 145
    assert all(0 <= r.quality <= 1 for r in out.values())
    one_class = cotraining.report(docs, labels.filter("quality = 1"))
    assert {r.kept for r in one_class.collect()} == {True} and cotraining.report(docs.limit(0), labels).count() == 0


# ---- hashes ----


def thue_morse(n, a="a", b="b"):
    """Two texts of 2^n letters that meet under every polynomial hash modulo a power of two, if n is large enough."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_structured_texts_do_not_meet(spark):
    pairs = [thue_morse(n) for n in (10, 11, 12)]
    rows = [(10 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    both = [(100 + i, f"{a}\n{b}") for i, (a, b) in enumerate(pairs)]
    counts = line_rules.quality_report(frame(spark, both)).collect()
    assert [(r.n_dup_lines, r.n_repeat_words) for r in counts] == [(0, 0)] * 3
    assert dedup_rows(spark, frame(spark, rows + both)) == plain_line_dedup(rows + both)
    got = sorted((tuple(r) for r in suffixes.report(frame(spark, rows), length=400).collect()), key=repr)
    assert got == plain_repeats(rows, 400)
    raw = np.frombuffer("".join(t for pair in pairs for t in pair).encode(), np.uint8)
    ends = np.cumsum([len(t) for pair in pairs for t in pair])
    for lane in (0, 1):
        assert len(set(textvec.word_hashes(raw, np.append(0, ends[:-1]), ends, lane).tolist())) == 6


def test_hashes_depend_on_bytes_alone(monkeypatch):
    r = np.random.default_rng(7)
    raw = r.integers(0, 256, 5000).astype(np.uint8)
    starts = np.array([0, 7, 4000])
    whole = [textvec.Prefixes(raw, lane).ranges(starts, starts + 900) for lane in (0, 1)]
    apart = [[textvec.Prefixes(raw[s : s + 900], lane).ranges(np.array([0]), np.array([900]))[0] for s in starts] for lane in (0, 1)]
    assert np.array_equal(whole, apart)
    monkeypatch.setattr(textvec, "CHUNK", 512)
    assert np.array_equal(whole, [textvec.Prefixes(raw, lane).ranges(starts, starts + 900) for lane in (0, 1)])
    plain = [sum((int(b) + 1) * pow(base, i, textvec.PRIME) for i, b in enumerate(raw[:900])) % textvec.PRIME for base in textvec.BASES[0]]
    assert whole[0][0] == textvec.mix(np.array([plain[0] << 31 | plain[1]], np.uint64))[0]


def test_crowded_words_meet_by_size(spark, monkeypatch):
    """One word in the prefix of sets of many sizes: cells of like sizes meet, and nothing is lost."""
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    monkeypatch.setattr(line_dedup, "MAX_FILTERED", 2)
    monkeypatch.setattr(line_dedup, "MAX_EARLY", 1)
    r = random.Random(11)
    rows = []
    for i in range(120):
        n = r.choice([1, 2, 4, 5, 6, 8, 10, 12, 15, 30, 38])
        rows.append((i, "hot " + " ".join(f"w{(r.randint(0, 2) * 7 + k) % 60}" for k in range(n))))
    assert dedup_rows(spark, frame(spark, rows)) == plain_line_dedup(rows)


def plain_cotraining(spark, rows, labels, most, rounds):
    """The same rounds over rows held in memory: every unlabelled document is scored by both views in each round."""
    import pyarrow as pa

    by_id = {r[0]: r for r in rows if r[0] is not None}
    parts = {i: cotraining.describe(*textvec.column_bytes(pa.array([r[1] or ""]))) for i, r in by_id.items()}
    x = {i: p.matrix()[0].astype(np.float16).astype(np.float32) for i, p in parts.items()}
    meta = {i: cotraining.metadata([r[2]], [r[3]], [r[4]])[0] for i, r in by_id.items()}
    y = {i: int(q) for i, q, _ in labels if i in by_id and q is not None}
    order = sorted(y, key=lambda i: (y[i], i))
    pick = lambda ids, of: np.stack([of[i] for i in ids]).astype(np.float32)
    t = cotraining.Trainer(pick(order, x), pick(order, meta), np.array([y[i] for i in order]), sum(y.values()) / len(y))
    t.refit()
    passed = [set(), set()]
    for turn in range(rounds):
        hashes = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in by_id], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(turn))).collect()}
        odds = [{i: t.views[0].odds(parts[i].scores(t.views[0].weights))[0] for i in by_id if i not in y}, {i: t.views[1].odds(meta[i] @ t.views[1].weights) for i in by_id if i not in y}]
        new = [{}, {}]
        for v in (0, 1):
            for label in (0, 1):
                p = {i: cotraining._sigmoid(np.array([o]))[0] for i, o in odds[v].items()}
                sure = sorted((i for i in p if (p[i] >= cotraining.CONFIDENT if label else p[i] <= 1 - cotraining.CONFIDENT)), key=lambda i: (hashes[i], i))
                new[v] |= dict.fromkeys([i for i in sure if i not in passed[v]][: most // 2], label)
            passed[v] |= set(new[v])
        for v, of in ((0, meta), (1, x)):
            if ids := sorted(new[v]):
                t.learn(1 - v, pick(ids, of), np.array([new[v][i] for i in ids]))
        t.history.append((len(new[0]), len(new[1])))
        t.refit()
    m = t.model()
    score = lambda i: m.combine(*(np.clip(o, -12, 12) for o in (m.text.odds(parts[i].scores(m.text.weights)), np.array([m.meta.odds(meta[i] @ m.meta.weights)]))))[0]
    return m.history, {i: score(i) for i in by_id}


def test_cotraining_scores_every_document_in_every_round(spark):
    r = random.Random(8)
    words = ["the", "river", "moves", "under", "stone", "bridges", "quietly", "today"]
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(r.choice(words) if good or r.random() < 0.5 else r.choice(["BUY", "NOW$$", "win&&"]) for _ in range(40))
        rows.append((i, text, r.choice(["en", "de", None]), "a" if good ^ (r.random() < 0.1) else "b", len(text)))
    rows += [(500, "very long " * 40_000, "en", "a", 400_000), (501, None, None, None, None), (None, "no id", None, None, 5)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 90)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("scores", F.lit(1)).withColumn("y", F.lit("x"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    history, want = plain_cotraining(spark, rows, labels, 20, 2)
    model = cotraining.train(docs.repartition(5), table, max_passed=20, rounds=2)
    assert model.history == history and sum(map(sum, history)) > 20
    got = {x.doc_id: x.s.quality for x in cotraining.score_documents(docs, model, "s").select("doc_id", "s").collect()}
    assert set(got) == {i for i, *_ in rows} and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    with pytest.raises(ValueError, match="scores"):
        cotraining.score_documents(docs, model)


def test_languages_equal_a_plain_pairwise_vote(spark):
    """Predictions against loops over pairs, and against separators fitted one by one."""
    import pyarrow as pa

    r = random.Random(9)
    bits = {"da": ["et", "og", "af"], "no": ["et", "og", "ikk"], "sv": ["ett", "och", "ikk"], "fr": ["eau", "ou", "que"], "es": ["ado", "ll", "que"], "zz": ["qx", "xq"]}
    text = lambda lang: " ".join("".join(r.choice(bits[lang]) for _ in range(2)) for _ in range(60))
    rows = [(lang, text(lang)) for lang in list(bits) * 30]
    spread = spark.createDataFrame([(t,) for _, t in rows], "t string").coalesce(1).select(language.profile(F.col("t")).alias("p")).collect()
    x = np.stack([np.frombuffer(p.p, np.float16) for p in spread]).astype(np.float32)
    langs = [lang for lang, _ in rows]
    model = language.learn(langs, x)
    # a column for each of four families, then the pairs da-no, da-sv, no-sv and es-fr
    assert [c[1:] for c in model.columns if c[0]] == [("da", "no"), ("da", "sv"), ("no", "sv"), ("es", "fr")] and model.weights.shape[1] == len(model.families) + 4
    for j, (f, a, b) in enumerate(model.columns):
        if f:
            mine = np.array([v in (a, b) for v in langs])
            alone = language._hinge(x[mine], np.array([[1 if v == a else -1] for v in langs if v in (a, b)]), language.EPOCHS, language.PENALTY)
            assert np.allclose(alone[:, 0], model.weights[:, j])
    fresh = [(lang, text(lang)) for lang in list(bits) * 10]
    got = [p["lang_pred"] for p in language._predict(model, pa.array([t for _, t in fresh])).to_pylist()]
    want = []
    for _, t in fresh:
        h, _ = language.trigrams(*textvec.column_bytes(pa.array([t])))
        margin = {c: sum(float(model.weights[i, j]) for i in h) for j, c in enumerate(model.columns)}
        f = max(model.families, key=lambda f: margin["", f, ""])
        votes = Counter({m: 0 for m in model.members[f]})
        total = Counter()
        for (of, a, b), value in margin.items():
            if of == f and of:
                votes[a if value >= 0 else b] += 1
                total[a] += value
                total[b] -= value
        want.append(max(votes, key=lambda m: (votes[m], total[m])))
    assert got == want and sum(g == lang for g, (lang, _) in zip(got, fresh, strict=True)) >= 0.97 * len(fresh)


@pytest.mark.parametrize("name", ["simhash", "language", "bpe", "rules", "suffixes"])
def test_empty_tables_and_clashing_columns(spark, name):
    """No rows give no rows, and columns that callers bring along do no harm."""
    path = public_tokenizers.path("word_bpe_49k.json")
    run = {
        "simhash": simhash.report, "language": language.language_report, "rules": line_rules.quality_report, "suffixes": suffixes.report,
        "bpe": lambda docs: bpe.digests(bpe.encode_documents(docs.select("doc_id", "text"), path)),
    }[name]
    docs = frame(spark, TRICKY)
    for c in ("id", "fp", "th", "body", "r", "key", "held_out", "score", "n_words", "lang_pred", "part", "component", "bpe", "ranges"):
        docs = docs.withColumn(c, F.lit(c))
    assert run(docs.limit(0)).count() == 0 and run(docs).count() == len(TRICKY)


def test_hashes_of_ranges_are_polynomials(monkeypatch):
    """Also where terms reach their largest sums and where ranges cross from one part of the sums to the next."""
    monkeypatch.setattr(textvec, "CHUNK", 50)
    assert 256 * textvec.PRIME * (1 << 22) + textvec.PRIME < textvec.ABOVE and textvec.ABOVE % textvec.PRIME == 0
    raw = np.array([255] * 60 + list(range(90)), np.uint8)
    starts, ends = np.array([0, 10, 49, 50, 99, 0]), np.array([150, 70, 51, 100, 101, 0])
    for lane, bases in enumerate(textvec.BASES):
        halves = [[sum((int(raw[i]) + 1) * pow(b, i - a, textvec.PRIME) for i in range(a, e)) % textvec.PRIME for a, e in zip(starts.tolist(), ends.tolist(), strict=True)] for b in bases]
        want = textvec.mix(np.array([x << 31 | y for x, y in zip(*halves, strict=True)], np.uint64))
        assert textvec.word_hashes(raw, starts, ends, lane).tolist() == want.tolist()
