"""Removal of lines that resemble earlier lines: an exact set-similarity join of the lines' word sets.

Words of a line are ordered from rare to frequent. Two sets with a Jaccard similarity of 4/5 or more share a
word in their prefixes, so sets meet under the words of their prefixes only; lengths, places of the shared word
and a bitmap of the set rule most of them out before whole sets are compared. A pair is counted under the first
word that it shares. Pairs never become rows: a set gets its number of links and its earliest partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import textvec
from heronry.llm.common import at_most, batch_slices, drop_path, materialise, materialise_at, trim

#: Similarity from which lines match, as a fraction.
NUM, DEN = 4, 5
#: Cells of the table of word frequencies; words that share a cell share a count, which costs time only.
CELLS = 1 << 19
CHUNK = 1 << 12
#: Bits that remember the sets with possible partners; wrong hits cost time only.
FILTER_BITS = 1 << 25
#: Sets under one word beyond which all pass on unfiltered (which costs time only), in pieces of that size, and sets
#: of it that one task compares.
MAX_FILTERED, BLOCK = 10_000, 2048
#: Cells of a matrix of sets by words that is held at once.
DENSE = 4_000_000
#: Sets under one word beyond which the words before it are not looked at.
MAX_EARLY = 200
#: Ratio of the sizes in a size class: a little over the largest ratio of sets that match, so that such sets lie in one
#: class or in neighbouring ones.
SIZE_RATIO = 1.26

#: Sets of more words than this also have a bitmap of WIDE_BITS bits, since 64 bits tell large sets little.
WIDE_FROM, WIDE_BITS = 40, 512

LINES = "doc_id long, th long, line int, sig long, check long, n int, bits long, wide binary, prefix array<long>"


def least_overlap(a, b):
    """Common words that sets of a and b words need: the similarity solved for the overlap, rounded up."""
    return (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(45)).astype(np.int64)


def _sets(raw: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, other: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct words of all lines in order of rarity: line of each and its hash; text and number of each line; and the
    words' hashes in the other lane, if asked for."""
    starts, ends, _ = textvec.words(raw, offsets)
    folded = textvec.ascii_lower(raw)
    h = textvec.word_hashes(folded, starts, ends)
    l_starts, _, l_doc = textvec.lines(raw, offsets)
    line = np.searchsorted(l_starts, starts, side="right") - 1
    number = np.arange(len(l_doc)) - np.searchsorted(l_doc, l_doc)
    at = rarity_order(line, h, ranks, len(l_doc))
    return line[at], h[at], l_doc, number, textvec.word_hashes(folded, starts[at], ends[at], 1) if other else h[:0]


def by_rarity(line: np.ndarray, h: np.ndarray, ranks: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and hashes in order of line and rarity, each hash of a line once."""
    at = rarity_order(line, h, ranks, n_lines)
    return line[at], h[at]


def rarity_order(line: np.ndarray, h: np.ndarray, ranks: np.ndarray, n_lines: int) -> np.ndarray:
    """Places in order of line and rarity, one for each hash of a line."""
    rank = ranks[_cell(h)]
    # one key holds line, rank and half of the hash; where halves meet, whole hashes decide
    by = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(32)) | (h >> np.uint64(32)))
    half = h[by] >> np.uint64(32)
    if n_lines >= 1 << 20 or ((half[1:] == half[:-1]) & (h[by][1:] != h[by][:-1]) & (line[by][1:] == line[by][:-1])).any():
        by = np.lexsort((h, rank, line))
    line, h = line[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return by[new]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 4096 steps, which orders them well enough."""
    return np.minimum(4095, np.log2(counts + 1.0) * 120).astype(np.uint64)


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = textvec.words(raw, offsets)
    return textvec.word_hashes(textvec.ascii_lower(raw), starts, ends)


def word_counts(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray] = _hashes) -> np.ndarray:
    """How often words (or what else hashes gives) of each cell occur, over all documents. CELLS numbers reach the
    driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batch_slices(batches, "text"):
            raw, offsets = textvec.column_bytes(batch.column("text"))
            total += np.bincount(_cell(hashes(raw, offsets)), minlength=CELLS)
        if total.any():
            chunks = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks))), pa.array([c.astype(np.uint32).tobytes() for c in chunks], pa.binary())], ["chunk", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in part.column("counts"))
        return pa.table({"chunk": part.column("chunk")[:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(count, "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.uint32)
    return out


def _signature(line: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, size, order-free hash and parity bitmap of each line's set."""
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(line)))
    if not len(first):
        return first, size, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sig = textvec.mix(np.add.reduceat(textvec.mix(h), first) + size.astype(np.uint64))
    return first, size, sig, np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), first)


def _wide_bitmaps(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity bitmaps of the large sets; null for the others."""
    out: list[bytes | None] = [None] * len(size)
    large = np.flatnonzero(size > WIDE_FROM)
    for k in range(0, len(large), 512):
        some = large[k : k + 512]
        owner = np.repeat(np.arange(len(some)), size[some])
        at = np.repeat(first[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        bit = (h[at] >> np.uint64(6) & np.uint64(WIDE_BITS - 1)).astype(np.int64)
        odd = np.bincount(owner * WIDE_BITS + bit, minlength=len(some) * WIDE_BITS).reshape(-1, WIDE_BITS) & 1
        for i, row in zip(some.tolist(), np.packbits(odd.astype(np.uint8), axis=1), strict=True):
            out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def _line_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each line with a word: place, set, and the words of the set's prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(counts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text"):
            line, h, l_doc, number, other = _sets(*textvec.column_bytes(batch.column("text")), shared.value, True)
            first, size, sig, bits = _signature(line, h)
            check = np.add.reduceat(textvec.mix(other), first) if len(first) else sig
            mine = line[first]
            reach = np.where(size * DEN < (size + 1) * NUM, 0, size - (NUM * size + DEN - 1) // DEN + 1)
            at = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(reach)), pa.int32()), pa.array(h[at].view(np.int64)))
            ids = [batch.column(c).take(pa.array(l_doc[mine])) for c in ("doc_id", "th")]
            columns = [*ids, pa.array(number[mine], pa.int32()), pa.array(sig.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size, pa.int32()), pa.array(bits.view(np.int64)), _wide_bitmaps(h, first, size), prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "line", "sig", "check", "n", "bits", "wide", "prefix"])

    return docs.mapInArrow(rows, LINES)


def _filter_group(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, sig: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which rows, sorted by word and size, may match another under the same word. bits: a row of 64-bit words each."""
    live = np.zeros(len(n), bool)
    edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(edge, len(word)))
    live[np.repeat(size > MAX_FILTERED, size)] = True
    todo = np.flatnonzero(~live)
    step = 1
    while len(todo):
        todo = todo[todo + step < len(n)]
        a, b = todo, todo + step
        near = (word[a] == word[b]) & (n[b] * NUM <= n[a] * DEN)
        todo, a, b = todo[near], a[near], b[near]
        need = least_overlap(n[a], n[b])
        fits = (sig[a] != sig[b]) & (1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= need)
        a, b, need = a[fits], b[fits], need[fits]
        fits = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= n[a] + n[b] - 2 * need
        live[a[fits]] = live[b[fits]] = True
        step += 1
    return live


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables that hold all rows of each key they have, from batches that are sorted by the keys, and true.

    A key of more than ``most`` rows comes in pieces of its own instead, with false, so that it is never held whole.
    """
    held: pa.Table | None = None
    open_: np.ndarray | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        key = np.stack([held.column(c).to_numpy() for c in keys])
        if open_ is not None:
            rest = np.flatnonzero((key != open_).any(0))
            mine = int(rest[0]) if len(rest) else held.num_rows
            if mine:
                yield held.slice(0, mine), False
                held, key = held.slice(mine), key[:, mine:]
            if not held.num_rows:
                continue
            open_ = None
        other = np.flatnonzero((key != key[:, -1:]).any(0))
        if len(other):
            yield held.slice(0, int(other[-1]) + 1), True
            held = held.slice(int(other[-1]) + 1)
        if most is not None and held.num_rows > most:
            yield held, False
            open_, held = key[:, -1:], None
    if held is not None and held.num_rows:
        yield held, True
    trim()


def _live(lines: DataFrame) -> DataFrame:
    """word and sig of sets that may match another set under a word of their prefixes."""
    each = lines.select("sig", "n", "bits", F.posexplode("prefix").alias("pos", "word"))
    postings = each.select("word", "sig", "bits", F.expr("n * 4294967296L + pos").alias("size_pos"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _whole_groups(batches, ("word",), MAX_FILTERED):
            word, sig, bits, packed = (t.column(c).to_numpy() for c in ("word", "sig", "bits", "size_pos"))
            # words and sizes in order, equal sets side by side
            group = np.cumsum(np.append(0, word[1:] != word[:-1]))
            by = np.lexsort((sig, group << 32 | packed >> 32))
            word, sig, bits, packed = (x[by] for x in (word, sig, bits, packed))
            new = np.append(True, (word[1:] != word[:-1]) | (sig[1:] != sig[:-1]))
            word, sig, bits, packed = (x[new] for x in (word, sig, bits, packed))
            n, pos = packed >> 32, packed & 0xFFFFFFFF
            live = _filter_group(n, pos, bits.view(np.uint64)[:, None], sig, word) if whole else np.ones(len(n), bool)
            yield pa.RecordBatch.from_arrays([pa.array(word[live]), pa.array(sig[live]), pa.array(pos[live].astype(np.int32))], names=["word", "sig", "pos"])

    return postings.repartition("word").sortWithinPartitions("word").mapInArrow(keep, "word long, sig long, pos int")


def _refined(live: DataFrame, sets: DataFrame) -> DataFrame:
    """live without what wide bitmaps rule out. sets: sig, n, wide and, where some are linked already, part: large
    sets stay only for partners of other parts."""
    part = "part" if "part" in sets.columns else "sig"
    rows = live.join(sets, "sig").select("word", "sig", "pos", "n", "wide", F.col(part).alias("side"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _whole_groups(batches, ("word",), MAX_FILTERED):
            if not whole:
                yield from t.select(["word", "sig", "pos"]).to_batches()
                continue
            word, sig, pos, n, side = (t.column(c).to_numpy() for c in ("word", "sig", "pos", "n", "side"))
            group = np.cumsum(np.append(0, word[1:] != word[:-1]))
            by = np.argsort(group << 32 | n.astype(np.int64), kind="stable")
            word, sig, pos, n, side = word[by], sig[by], pos[by].astype(np.int64), n[by].astype(np.int64), side[by]
            wide = t.column("wide").combine_chunks().take(pa.array(by))
            small = np.flatnonzero(wide.is_null().to_numpy(zero_copy_only=False))
            raw, _ = textvec.column_bytes(pc.fill_null(wide, bytes(WIDE_BITS // 8)))
            bits = raw.view(np.uint64).reshape(len(word), -1)
            live = np.zeros(len(word), bool)
            live[small] = True
            live |= _filter_group(n, pos, bits, side, word)
            # a large set whose only partners are small ones has none: sizes lie too far apart, but for the border
            live |= (n * NUM <= (WIDE_FROM + 1) * DEN)
            yield pa.RecordBatch.from_arrays([pa.array(word[live]), pa.array(sig[live]), pa.array(pos[live].astype(np.int32))], names=["word", "sig", "pos"])

    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(keep, "word long, sig long, pos int")


def _needed(live: DataFrame) -> DataFrame:
    """word and sig where the set may have a partner with which it shares no live word before this one.

    All other meetings of a set happen under an earlier word. Groups of more than MAX_EARLY pass whole.
    """
    ordered = live.groupBy("sig").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("w"))
    each = ordered.select("sig", "w", F.posexplode("w").alias("i", "p")).select(F.col("p.word").alias("word"), "sig", F.transform(F.slice("w", F.lit(1), F.col("i")), lambda e: e["word"]).alias("early"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, complete in _whole_groups(batches, ("word",), 50 * MAX_EARLY):
            if not complete:
                yield from t.select(["word", "sig"]).to_batches()
                continue
            word, sig = t.column("word").to_numpy(), t.column("sig").to_numpy()
            early = t.column("early").combine_chunks()
            size = early.value_lengths().to_numpy(zero_copy_only=False)
            edge = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
            whole = np.minimum.reduceat(size, edge[:-1]) == 0
            hit = np.repeat(whole | (np.diff(edge) > MAX_EARLY), np.diff(edge))
            for g in np.flatnonzero(~whole & (np.diff(edge) > 1) & (np.diff(edge) <= MAX_EARLY)).tolist():
                sets = [frozenset(x) for x in early.slice(edge[g], edge[g + 1] - edge[g]).to_pylist()]
                kinds = set(sets)
                if len(kinds) > 1:
                    apart = {a for a in kinds if any(a.isdisjoint(b) for b in kinds)}
                    hit[edge[g] : edge[g + 1]] = [x in apart for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(word[hit]), pa.array(sig[hit])], names=["word", "sig"])

    return each.repartition("word").sortWithinPartitions("word").mapInArrow(keep, "word long, sig long")


def _membership(sigs: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with one bit set for each signature; its size is fixed."""
    bit = F.pmod(F.col("sig"), F.lit(FILTER_BITS))
    cells = sigs.select(F.floor(bit / 64).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(pmod(sig, 64) as int))").alias("b")).groupBy("cell").agg(F.bit_or("b").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    got = cells.toPandas()
    out[got["cell"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _whole_sets(docs: DataFrame, counts: np.ndarray, member: np.ndarray) -> DataFrame:
    """sig and all words, in order of rarity, of the sets that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast((_ranks(counts), member))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, member = shared.value
        for batch in batch_slices(batches, "text"):
            line, h, *_ = _sets(*textvec.column_bytes(batch.column("text")), ranks)
            first, size, sig, _ = _signature(line, h)
            bit = (sig.view(np.int64) % FILTER_BITS).astype(np.uint64)
            hit = np.flatnonzero(member[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            _, once = np.unique(sig[hit], return_index=True)
            hit = hit[once]
            words = h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit].view(np.int64)), pa.array([words[a : a + n].tobytes() for a, n in zip(first[hit].tolist(), size[hit].tolist(), strict=True)], pa.binary())], names=["sig", "words"])

    return docs.select("text").mapInArrow(rows, "sig long, words binary").groupBy("sig").agg(F.min("words").alias("words"))


def _pairs(sets: list[np.ndarray], place: list[int], cross: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets that match and share no word before the group's; cross: the sets' sides, if only pairs
    of different sides count."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 6:
        whole, early = [set(s.tolist()) for s in sets], [set(s[:p].tolist()) for s, p in zip(sets, place, strict=True)]
        found = [(i, j) for i in range(m) for j in range(i + 1, m) if (cross is None or cross[i] != cross[j]) and (NUM + DEN) * len(whole[i] & whole[j]) >= NUM * (size[i] + size[j]) and not early[i] & early[j]]
        return (np.array([p[k] for p in found], np.int64) for k in (0, 1))
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    before = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(place, size)
    step = max(1, min(m, DENSE // max(1, len(words))))
    out = ([], [])
    parts = [(b, min(b + step, m)) for b in range(0, m, step)]

    def dense(b: int, e: int, only: np.ndarray | None = None) -> np.ndarray:
        mine = (owner >= b) & (owner < e)
        if only is not None:
            mine &= only
        x = np.zeros((e - b, len(words)), np.float32)
        x[owner[mine] - b, code[mine]] = 1
        return x

    for b, e in parts:
        left, left_early = dense(b, e), dense(b, e, before)
        for c, f in parts:
            if c < b:
                continue
            both = left @ (dense(c, f) if c != b else left).T
            ok = (NUM + DEN) * both >= NUM * (size[b:e, None] + size[None, c:f]) - 0.25
            i, j = np.nonzero(ok)
            i, j = i + b, j + c
            some = i < j
            if cross is not None:
                some &= cross[i] != cross[j]
            i, j = i[some], j[some]
            if len(i):
                right_early = dense(c, f, before) if c != b else left_early
                clear = (left_early[i - b] * right_early[j - c]).sum(1) == 0 if len(i) < 20_000 else (left_early @ right_early.T == 0)[i - b, j - c]
                out[0].append(i[clear])
                out[1].append(j[clear])
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def dealt(live: DataFrame, sets: DataFrame) -> DataFrame:
    """live with the columns of sets and i, j and own: the cells that meet, and the row's own one.

    A crowded word's sets are dealt into cells by size class and hash. Two cells meet in a task of their own if they
    are of one class or of neighbouring ones; sets of other classes are too unlike in size to match.
    """
    zero = F.lit(0)
    crowd = materialise(live.groupBy("word").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("word"), "crowd")
    if not crowd.take(1):
        return live.select("*", zero.alias("i"), zero.alias("j"), zero.alias("own")).join(sets, "sig")
    easy = live.join(crowd, "word", "left_anti").select("word", "sig", zero.alias("i"), zero.alias("j"), zero.alias("own"))
    size = F.octet_length("words") / 8
    hard = live.join(crowd, "word", "left_semi").select("word", "sig").join(sets.select("sig", F.floor(F.log(size) / F.log(F.lit(SIZE_RATIO))).cast("int").alias("class")), "sig")
    cells = hard.groupBy("word", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"))
    cells = cells.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("class", "cells"))).alias("cells"))
    first = F.shiftleft("class", 20)
    near = lambda step: F.coalesce(F.transform(F.sequence(zero, F.try_element_at("cells", F.col("class") + step) - 1), lambda k: F.shiftleft(F.col("class") + step, 20) + k), F.array().cast("array<int>"))
    hard = hard.join(cells, "word").withColumn("own", first + F.pmod(F.xxhash64("sig"), F.try_element_at("cells", F.col("class"))).cast("int"))
    hard = hard.withColumn("met", F.explode(F.concat(near(F.lit(-1)), near(F.lit(0)), near(F.lit(1)))))
    hard = hard.select("word", "sig", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own")
    return easy.unionByName(hard).join(sets, "sig")


def set_links(docs: DataFrame, lines: DataFrame, counts: np.ndarray) -> DataFrame:
    """sig, first place, links (how many other sets match) and earliest place of a match, for sets with a match."""
    first = materialise(lines.groupBy("sig").agg(F.min(F.struct("doc_id", "th", "line", "check")).alias("first"), F.first("n").alias("n"), F.first("wide").alias("wide")), "first-lines")
    spark = docs.sparkSession
    live, live_at = materialise_at(_live(lines), "live")
    refined, refined_at = materialise_at(_refined(live, first.select("sig", "n", "wide")), "refined")
    drop_path(spark, live_at)  # what replaces a table is written
    first = first.select("sig", "first")
    member = _membership(refined.select("sig").distinct())
    live = materialise(_needed(refined), "needed")
    drop_path(spark, refined_at)
    sets = _whole_sets(docs, counts, member).join(first, "sig")
    rows = dealt(live, sets).select("word", "i", "j", "own", "sig", "words", "first.doc_id", "first.th", "first.line")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _whole_groups(batches, ("word", "i", "j")):
            yield matched(t)

    names = ["sig", "links", "doc_id", "th", "line"]

    def matched(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(c).to_numpy() for c in ("word", "i", "j")])
        edge = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), t.num_rows)
        own, sig = t.column("own").to_numpy(), t.column("sig").to_numpy()
        ids, th, line = t.column("doc_id").to_pylist(), t.column("th").to_pylist(), t.column("line").to_pylist()
        raw = t.column("words").to_pylist()
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            sets = [np.frombuffer(w, np.int64) for w in raw[a:b]]
            place = [int(np.flatnonzero(s == key[0, a])[0]) for s in sets]
            i, j = _pairs(sets, place, own[a:b] if key[1, a] != key[2, a] else None)
            if not len(i):
                continue
            order = sorted(range(a, b), key=lambda k: (ids[k] is not None, ids[k] or 0, th[k], line[k]))
            rank = np.empty(b - a, np.int64)
            rank[np.array(order) - a] = np.arange(b - a)
            links = np.bincount(np.concatenate([i, j]), minlength=b - a)
            best = np.full(b - a, b - a)
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
            for k in np.flatnonzero(links).tolist():
                o = order[best[k]]
                out.append((sig[a + k], links[k], ids[o], th[o], line[o]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = rows.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j").mapInArrow(join, "sig long, links long, doc_id long, th long, line int")
    found = found.groupBy("sig").agg(F.sum("links").alias("links"), F.min(F.struct("doc_id", "th", "line")).alias("match"))
    return first.join(found, "sig", "left")


def judged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th and, for each document with words, its lines' verdicts: removed line numbers and sums.

    docs: doc_id, th, text. A line is removed if a line before it, by doc_id (null first), hash of the text and
    number, has the same words or matches them. Sets of words are told apart by 64 bits, and before a line goes they
    must agree in 64 more, of other hashes of their words; a match by similarity rests on the first 64. Rows equal in
    doc_id and th are one document.
    """
    docs = at_most(docs, 1)
    counts = word_counts(docs)
    lines = materialise(_line_rows(docs, counts), "lines")
    links = materialise(set_links(docs, lines, counts), "links")
    place, first = F.struct("doc_id", "th", "line"), F.struct("first.doc_id", "first.th", "first.line")
    each = lines.select("doc_id", "th", "line", "sig", "check").join(links, "sig")
    each = each.withColumn("same", F.col("check") == F.col("first.check")).withColumn("first", first)
    removed = F.col("same") & ((place != F.col("first")) | F.coalesce(F.col("match") < F.col("first"), F.lit(False)))
    return each.groupBy("doc_id", "th").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sort_array(F.collect_list(F.when(removed, F.col("line")))).alias("removed"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.min(F.when(removed, F.least(F.col("first"), F.coalesce(F.col("match"), F.col("first"))))).getField("doc_id").alias("earliest"),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def remove_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """docs with the text of each document less its removed lines, all other columns as they are.

    Lines without a word stay; a null text stays null. Documents that lose all lines with words go, unless
    drop_emptied is false. Rows equal in id and text are one document in the order of lines and keep the same lines.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("k_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("k_th"))
    verdict = judged_lines(_keyed(docs, id_col, text_col)).select("doc_id", "th", "n_lines", "removed")
    at = (F.coalesce(F.col("k_id"), F.lit(0)) == F.coalesce(F.col("doc_id"), F.lit(0))) & (F.col("k_th") == F.col("th")) & (F.col("k_id").isNull() == (F.col("doc_id").isNull() & F.col("th").isNotNull()))
    joined = own.join(verdict, at, "left")
    if drop_emptied:
        joined = joined.filter(F.col("n_lines").isNull() | (F.size("removed") < F.col("n_lines")))

    @F.arrow_udf(T.StringType())
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in batches:
            out = []
            for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
                if text and gone:
                    lost = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost)
                out.append(text)
            yield pa.array(out, pa.string())

    text = without(F.col(f"row.{text_col}").cast("string"), F.col("removed"))
    return joined.select("row", text.alias("cut")).select(*(F.col("cut").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Of every document: doc_id, n_lines (with words), removed line numbers, n_links of its lines to other word
    sets, and the smallest doc_id that holds a line because of which it lost one."""
    rows = _keyed(docs, "doc_id", "text")
    verdict = judged_lines(rows).withColumnRenamed("doc_id", "v_id").withColumnRenamed("th", "v_th")
    at = (F.coalesce(F.col("doc_id"), F.lit(0)) == F.coalesce(F.col("v_id"), F.lit(0))) & (F.col("th") == F.col("v_th")) & (F.col("doc_id").isNull() == (F.col("v_id").isNull() & F.col("v_th").isNotNull()))
    zero = F.lit(0).cast("long")
    out = rows.select("doc_id", "th").join(verdict, at, "left")
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"), F.coalesce("n_links", zero).alias("n_links"), F.col("earliest").alias("earliest_doc_id"))
