"""Removal of byte strings that occur elsewhere, by a distributed merge sort of suffixes that knows common prefixes.

Which suffixes take part. Every window of ``length`` bytes has an anchor: the least hash among its ``GRAM``-byte
strings, a choice that its bytes alone decide. Equal windows have equal anchors at equal places, so only anchors
whose hash occurs twice or more are of use, and one suffix stands for all windows that share an anchor. Anchors
with equal surroundings (a *class*, known by hashes of two lanes, 124 bits) are exchanged twice at most and share
the verdict. An anchor with very many different surroundings is taken apart: each of its windows is a class of its
own, and only those that two hashes call repeated are exchanged and compared.

The sort. Tasks sort suffixes from the anchors on, and exchange them as front-coded runs (the length of what each
shares with the one before, and its rest), cut at splitters. A task merges its runs with a loser tree whose
nodes keep the known common prefix with the last winner: bytes found equal are never compared again. The merge
yields common prefixes of neighbours; a group that shares an anchor's bytes is then matched to the left as well,
and windows that two of its members hold are repeated.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import textvec
from heronry.llm.common import at_most, batch_slices, drop_path, materialise, materialise_at, same_row

#: Bytes hashed for an anchor.
GRAM = 100
#: Bytes of suffixes in a sorted run, and aimed at in a merge task.
RUN_BYTES, PART_BYTES = 24 << 20, 6 << 20
#: Strings drawn for splitters, for each part that they cut, at least; about four times as many are.
DRAWN = 16
#: Different surroundings of one anchor that stay in one group of a merge; beyond, its windows are classes themselves.
MAX_SPANS = 20_000

ANCHOR = "doc_id long, th long, kg long, sh long, at long, back int, fwd int"
RUN = "part int, lcp array<int>, rest array<binary>, prior array<binary>, kg array<long>, sh array<long>, back array<int>, fwd array<int>"


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, place, and first and last window start of every anchor, as positions in raw."""
    n, width = len(raw), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    least = textvec.rolling(raw, gram)
    least = (least >> np.uint64(32) << np.uint64(32)) | np.arange(n - gram + 1, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    starts = np.flatnonzero(offsets[1:][doc] - np.arange(n - length + 1) >= length)
    if not len(starts):
        return empty, empty, empty, empty
    place, doc = place[starts], doc[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], place[first], starts[first], starts[last]


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def _common_end(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :]) ^ int.from_bytes(b[len(b) - n :])
    return n if not x else ((x & -x).bit_length() - 1) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each of the sorted strings, the length it shares with the one before and the rest."""
    lcp, rest, before = [], [], b""
    for s in strings:
        h = _common(before, s, 0)
        lcp.append(h)
        rest.append(s[h:])
        before = s
    return lcp, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge front-coded runs: the prefix shared with the string before, the run, the index in it, the string.

    A loser tree. Each string that waits has its common prefix with the last winner; of two, the one that shares
    more is less, and only if both share the same are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text: list[bytes | None] = [None] * k
    shared, index = [0] * k, [0] * k
    for r, (_, rest) in enumerate(runs):
        text[r] = rest[0] if rest else None

    def lesser(a: int, b: int) -> tuple[int, int]:
        if text[b] is None:
            return a, b
        if text[a] is None or shared[b] > shared[a]:
            return b, a
        if shared[a] > shared[b]:
            return a, b
        h = _common(text[a], text[b], shared[a])
        if text[b][h : h + 1] < text[a][h : h + 1]:
            a, b = b, a
        shared[b] = h
        return a, b

    losers = [0] * k
    level = list(range(k))
    at = k // 2
    while len(level) > 1:
        pairs = [lesser(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        losers[at : at + len(pairs)] = [b for _, b in pairs]
        level = [a for a, _ in pairs]
        at //= 2
    winner = level[0]
    while (string := text[winner]) is not None:
        i = index[winner]
        yield shared[winner], winner, i, string
        lcp, rest = runs[winner]
        index[winner] = i = i + 1
        if i < len(rest):
            shared[winner] = lcp[i]
            text[winner] = string[: lcp[i]] + rest[i]
        else:
            text[winner] = None
        node = (k + winner) // 2
        while node:
            winner, losers[node] = lesser(winner, losers[node])
            node //= 2


def _repeated(lcps: list[int], members: list[tuple[bytes, int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each member of a group in suffix order, ranges of offsets (anchor less window start) that are repeated.

    lcps[i] is the prefix that member i shares with the one before. A member: what stands left of the anchor, the
    least and the largest offset of its windows, and its count. Two members share the window at offset o if they
    share o bytes to the left and length - o to the right.
    """
    n = len(members)
    out: list[list[tuple[int, int]]] = [[(m[1], m[2])] if m[3] > 1 else [] for m in members]
    if n <= 16:
        for i in range(n):
            right = length
            for j in range(i + 1, n):
                right = min(right, lcps[j])
                low, high = length - right, _common_end(members[i][0], members[j][0])
                for m in (i, j):
                    a, b = max(low, members[m][1]), min(high, members[m][2])
                    if a <= b and members[m][3] == 1:
                        out[m].append((a, b))
        return out
    backward = [m[0][::-1] for m in members]
    order = sorted(range(n), key=backward.__getitem__)
    left = np.array([0] + [_common(backward[order[i - 1]], backward[order[i]], 0) for i in range(1, n)])
    right = np.array([0, *lcps[1:]])
    order = np.array(order)
    low, high = np.array([m[1] for m in members]), np.array([m[2] for m in members])
    step = max(1, 2_000_000 // n)
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(int(low.min()), int(high.max()) + 1, step):
        o = np.arange(begin, min(begin + step, int(high.max()) + 1))[:, None]
        to_right = np.cumsum(right[None] < length - o, axis=1)
        to_left = np.empty_like(to_right)
        to_left[:, order] = np.cumsum(left[None] < o, axis=1)
        key = to_right * (n + 1) + to_left
        by = np.argsort(key, axis=1, kind="stable")
        ranked = np.take_along_axis(key, by, 1)
        same = np.zeros(key.shape, bool)
        same[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        same[:, :-1] |= same[:, 1:]
        hit = np.empty_like(same)
        np.put_along_axis(hit, by, same, 1)
        hit &= (o >= low) & (o <= high)
        spans.append((np.nonzero(hit.T)[0], np.nonzero(hit.T)[1] + begin))
    member = np.concatenate([s[0] for s in spans])
    offset = np.concatenate([s[1] for s in spans])
    by = np.lexsort((offset, member))
    member, offset = member[by], offset[by]
    cut = np.flatnonzero((np.diff(member) != 0) | (np.diff(offset) != 1)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(member)).tolist(), strict=True):
        if b > a and members[int(member[a])][3] == 1:
            out[int(member[a])].append((int(offset[a]), int(offset[b - 1])))
    return out


def _merge_part(length: int, gram: int):
    def merge(part: pa.Table) -> pa.Table:
        columns = {c: part.column(c).to_pylist() for c in part.column_names if c != "part"}
        found: list[tuple[int, int, int, int]] = []
        lcps: list[int] = []
        group: dict[tuple[bytes, bytes], list] = {}

        def close() -> None:
            members = [(prior, v[0], v[1], v[2]) for (_, prior), v in group.items()]
            if len(members) > 1 or members and members[0][3] > 1:
                for v, ranges in zip(group.values(), _repeated(lcps, members, length), strict=True):
                    found.extend((kg, sh, a, b) for kg, sh in v[3] for a, b in ranges)
            group.clear()
            lcps.clear()

        since = 0
        for h, run, i, string in merge_runs(list(zip(columns["lcp"], columns["rest"], strict=True))):
            if h < gram:
                close()
                since = length
            since = min(since, h)
            prior = columns["prior"][run][i]
            name = (columns["kg"][run][i], columns["sh"][run][i])
            if (known := group.get((string, prior))) is not None:
                known[2] += 1
                known[3].add(name)
            else:
                group[(string, prior)] = [columns["fwd"][run][i], columns["back"][run][i], 1, {name}]
                lcps.append(since)
                since = length
        close()
        kind = pa.schema([("kg", pa.int64()), ("sh", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)] if found else [pa.array([], f.type) for f in kind], schema=kind)

    return merge


def _find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "body"):
            raw, offsets = textvec.column_bytes(batch.column("body"))
            doc, place, first, last = anchors(raw, offsets, length, gram)
            if not len(doc):
                continue
            kg = textvec.Prefixes(raw).ranges(place, place + gram)
            sh = textvec.Prefixes(raw, 1).ranges(first, last + length) + textvec.mix(place - first)
            ids = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "th")]
            back, fwd = (place - first).astype(np.int32), (place - last).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.view(np.int64)) for x in (kg, sh)), pa.array(place - offsets[doc]), pa.array(back), pa.array(fwd)], names=["doc_id", "th", "kg", "sh", "at", "back", "fwd"])

    return docs.mapInArrow(find, ANCHOR)


def _splitters(rows: DataFrame, n: int, gram: int) -> list[bytes]:
    """n - 1 starts of the strings that are merged, which cut a sample of them into equal parts.

    rows: body, and list (kg, sh, at, back, fwd), a sample of some DRAWN strings for each part.
    """
    if n < 2:
        return []

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, picks in zip(batch.column("body"), batch.column("picks"), strict=True):
                body = body.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([body[p["at"] : p["at"] + gram] for p in picks.as_py()], pa.binary())], ["g"])

    got = sorted(r.g for r in rows.select("body", "picks").mapInArrow(some, "g binary").collect())
    return sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []


def _sorted_runs(rows: DataFrame, splitters: list[bytes], length: int) -> DataFrame:
    """Front-coded sorted runs, one row for each run and part. rows: body, and list (kg, sh, at, back, fwd)."""
    names = ["part", "lcp", "rest", "prior", "kg", "sh", "back", "fwd"]

    def emit(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda e: e[0])
        cuts = [bisect_right(splitters, e[0][: len(splitters[0])]) if splitters else 0 for e in held]
        rows, begin = [], 0
        for i in range(1, len(held) + 1):
            if i == len(held) or cuts[i] != cuts[begin]:
                mine = held[begin:i]
                lcp, rest = front_coded([e[0] for e in mine])
                rows.append((cuts[begin], lcp, rest, *([e[j] for e in mine] for j in range(1, 6))))
                begin = i
        kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for body, picks in zip(batch.column("body"), batch.column("picks"), strict=True):
                body = body.as_py()
                for p in picks.as_py():
                    at = p["at"]
                    held.append((body[at : at - p["fwd"] + length], body[at - p["back"] : at], p["kg"], p["sh"], p["back"], p["fwd"]))
                    size += 2 * length
                if size > RUN_BYTES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return rows.select("body", "picks").mapInArrow(sort, RUN)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """kg, sh, o, the window's hashes h1 and h2, its text's doc_id and th and its place, for every window of the
    picked surroundings. rows: doc_id, th, body, and list (kg, sh, at, back, fwd)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (body, picks) in enumerate(zip(batch.column("body"), batch.column("picks"), strict=True)):
                raw = np.frombuffer(body.as_py(), np.uint8)
                lanes = [textvec.Prefixes(raw, lane) for lane in (0, 1)]
                picks = picks.as_py()
                size = np.array([p["back"] - p["fwd"] + 1 for p in picks])
                o = np.concatenate([np.arange(p["fwd"], p["back"] + 1) for p in picks])
                at = np.repeat(np.array([p["at"] for p in picks]), size) - o
                ids = [pa.repeat(batch.column(c)[i], len(o)) for c in ("doc_id", "th")]
                keys = [pa.array(np.repeat(np.array([p[c] for p in picks]), size)) for c in ("kg", "sh")]
                hashes = [pa.array(x.ranges(at, at + length).view(np.int64)) for x in lanes]
                yield pa.RecordBatch.from_arrays([*ids, *keys, pa.array(o.astype(np.int32)), *hashes, pa.array(at)], names=["doc_id", "th", "kg", "sh", "o", "h1", "h2", "at"])

    return rows.select("doc_id", "th", "body", "picks").mapInArrow(windows, "doc_id long, th long, kg long, sh long, o int, h1 long, h2 long, at long")


_PLACE = ("doc_id", "th", "at", "back", "fwd")


def _classes(rows: DataFrame, one: str, other: str) -> DataFrame:
    """kg and sh, from two hash columns, with the number of rows and the first and the last place."""
    place = F.struct(*_PLACE)
    return rows.groupBy(F.col(one).alias("kg"), F.col(other).alias("sh")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))


def _verdicts(docs: DataFrame, classes: DataFrame, length: int, gram: int) -> DataFrame:
    """kg, sh and the ranges of offsets (low to high) whose windows are repeated, by sorted runs and their merge."""
    total = classes.select(F.sum(F.when(F.col("n") > 1, 2).otherwise(1))).first()[0] or 0
    parts = max(1, -(-total * length * 3 // (2 * PART_BYTES)))
    cuts = []
    if parts > 1:
        # splitters come from the strings of some documents, so that no other text is moved for them
        share = min(1.0, 4 * DRAWN * parts / total)
        drawn = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        cuts = _splitters(same_row(docs.filter(drawn("doc_id", "th")), _picks(classes, drawn("p.doc_id", "p.th"))), parts, gram)
    runs = _sorted_runs(same_row(docs, _picks(classes)), cuts, length)
    return runs.groupBy("part").applyInArrow(_merge_part(length, gram), "kg long, sh long, low int, high int")


def _picks(classes: DataFrame, where: Column | None = None) -> DataFrame:
    """doc_id, th and ``picks``, all first and last places of classes in that text."""
    twice = F.explode(F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("p")
    each = classes.select("kg", "sh", twice)
    return (each if where is None else each.filter(where)).groupBy("p.doc_id", "p.th").agg(F.collect_list(F.struct("kg", "sh", "p.at", "p.back", "p.fwd")).alias("picks"))


def _busy_verdicts(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """_verdicts for classes of anchors with too many surroundings for one group: their windows are the classes."""
    each = materialise(_windows(same_row(docs, _picks(classes)), length), "windows")
    zero = F.lit(0).alias
    again = _classes(each.select("doc_id", "th", "at", zero("back"), zero("fwd"), "h1", "h2"), "h1", "h2").filter("n > 1")
    found = _verdicts(docs, materialise(again, "window-classes"), length, length).select(F.col("kg").alias("h1"), F.col("sh").alias("h2")).distinct()
    return each.join(found, ["h1", "h2"], "left_semi").select("kg", "sh", F.col("o").alias("low"), F.col("o").alias("high")).distinct()


def repeated_ranges(docs: DataFrame, length: int = 400, gram: int = GRAM, max_spans: int = MAX_SPANS) -> DataFrame:
    """doc_id, th and ranges (begin, end) of bytes that lie in a repeated string. docs: doc_id, th, body.

    max_spans decides how an anchor is worked through, never what is found.
    """
    found, anchors_at = materialise_at(_find_anchors(docs, length, gram), "anchors")
    # written first, so that the join has a shuffle of its own on both sides, whose large partitions Spark can split
    common = materialise(found.groupBy("kg").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "common")
    kept = materialise(found.join(common, "kg", "left_semi"), "repeated")
    drop_path(docs.sparkSession, anchors_at)  # repeated is written and takes its place
    classes, classes_at = materialise_at(_classes(kept, "kg", "sh"), "classes")
    busy = classes.groupBy("kg").agg(F.count(F.lit(1)).alias("spans")).filter(F.col("spans") > max_spans).select("kg")
    if busy.take(1):
        busy = materialise(busy, "busy")
        verdicts = _verdicts(docs, classes.join(busy, "kg", "left_anti"), length, gram).unionByName(_busy_verdicts(docs, classes.join(busy, "kg", "left_semi"), length))
    else:
        verdicts = _verdicts(docs, classes, length, gram)
    verdicts = materialise(verdicts, "verdicts")
    drop_path(docs.sparkSession, classes_at)
    begin, end = F.col("at") - F.col("high"), F.col("at") - F.col("low") + length
    return kept.join(verdicts, ["kg", "sh"]).select("doc_id", "th", begin.alias("begin"), end.alias("end"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, spans (removed ranges of bytes, merged and in order) and kept, the bytes that stay.

    A byte is removed if it lies in a string of ``length`` bytes that also starts somewhere else, in the same
    document or another; judged on the input, overlaps count. A null text is empty, texts below ``length`` stay.
    Rows that are equal repeat each other. Every row gives a row. kept is bytes, since a range may begin or end
    inside a character.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumn("th", F.xxhash64("body"))
    # two copies of a row repeat each other as any number does
    ranges = repeated_ranges(at_most(rows, 2), length, **options).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "body"):
            spans, kept, sizes = [], [], []
            for body, ranges in zip(batch.column("body").to_pylist(), batch.column("ranges"), strict=True):
                out, stay, at = [], [], 0
                flat = ranges.values.flatten() if ranges.is_valid else ()
                if len(flat):
                    a, b = (x.to_numpy() for x in flat)
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    new = np.append(True, a[1:] > b[:-1])
                    first = np.flatnonzero(new)
                    for s, e in zip(a[first].tolist(), b[np.append(first[1:], len(b)) - 1].tolist(), strict=True):
                        out.append({"begin": s, "end": e})
                        stay.append(body[at:s])
                        at = e
                spans.append(out)
                kept.append(b"".join([*stay, body[at:]]))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=kind.names)

    return same_row(rows, ranges, "left").select("doc_id", "body", "ranges").mapInArrow(cut, kind)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    out = remove_repeats(docs, **options)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
