"""Line-first cleaning: rules for single lines first, then a verdict on how much text they took.

Boilerplate is learned from all documents of a source: a short line that many different documents share, whatever its
digits and case. Two documents count as different if their longest lines differ, so that copies and near copies of one
document count once however many there are (and so do documents whose longest line is the same licence). A list of well-known phrases stands beside it for lines that occur once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import textvec
from heronry.llm.common import free_name, in_slices, materialise, require_free

#: A document fails at once below so many words, or above this share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line fails above these shares of its words.
MAX_MARKED, MAX_SEPARATORS, MAX_STUTTER = 0.3, 0.1, 0.3
#: A line without an end mark fails if it has fewer words than this.
MIN_OPEN_WORDS = 8
#: A document is rejected if failed lines hold more than this share of its word characters.
MAX_LOST = 0.4
#: A line is shared if it stands in so many different documents of its source at least, and in this share (percent) of them.
SHARED_DOCUMENTS, SHARED_PERCENT = 10, 1
#: Longer lines are text that documents share, not boilerplate.
MAX_BOILER_WORDS = 40
#: Parts that the lines of one key are dealt to when they meet the shared ones.
SALTS = 16
#: Phrases of lines that web pages repeat, in the languages that the rules know.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "we use cookies", "accept cookies", "terms of use",
    "terms of service", "enable javascript", "sign up for our newsletter", "subscribe to our newsletter",
    "click here to", "skip to content", "back to top", "powered by", "share on facebook", "follow us on",
    "licensed under", "released under the", "under the gnu general public license",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies", "zum inhalt springen", "nach oben scrollen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "nous utilisons des cookies", "aller au contenu", "retour en haut",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utilizamos cookies", "saltar al contenido", "volver arriba",
)
END_MARKS = (".", "!", "?", "\"", "'", ":", ";", ")", "]", "…", "”", "’", "»", "。", "！", "？")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|>/")] = True
_ASCII_END = np.zeros(256, bool)
_ASCII_END[[ord(x) for x in END_MARKS if ord(x) < 128]] = True
_WIDE_END = re.compile(b"|".join(x.encode() for x in END_MARKS if ord(x) >= 128))
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars")
#: A line that passed the rules for single lines: its number, two hashes of its masked form, characters in words.
OPEN = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("key", "check", "chars"))]))
MEASURES = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("main", T.LongType()), T.StructField("open", OPEN), T.StructField("failed", T.ArrayType(T.IntegerType()))])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def _seen_before(*keys: np.ndarray) -> np.ndarray:
    """Which places equal an earlier one in all keys."""
    order = np.lexsort(keys)
    later = np.zeros(len(order), bool)
    later[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.empty(len(order), bool)
    out[order] = later
    return out


def measure(raw: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Counts for each text; text, failure and masked form of each line, and whether it may turn out to be boilerplate."""
    n = len(offsets) - 1
    prefix = textvec.Prefixes(raw)
    starts, ends, doc = textvec.words(raw, offsets)
    hashes = prefix.ranges(starts, ends)
    chars_to = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars_to[1:])
    symbols_to = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_SYMBOL[raw], out=symbols_to[1:])
    chars = chars_to[ends] - chars_to[starts]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, chars, n).astype(np.int64), "n_symbols": symbols_to[offsets[1:]] - symbols_to[offsets[:-1]]}

    salt = textvec.mix(np.arange(1, n + 1, dtype=np.uint64))
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        at = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1])
        keys = salt[doc[at]]
        for j in range(WINDOW):
            keys = (keys ^ hashes[at + j]) * np.uint64(textvec.BASE)
            keys ^= keys >> np.uint64(32)
        hit = at[_repeated(keys)]
        np.add.at(repeat, hit, 1)
        np.add.at(repeat, hit + WINDOW, -1)
    covered = np.cumsum(repeat)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    l_starts, l_ends, l_doc = textvec.lines(raw, offsets)
    k = len(l_starts)
    # lines stand in order of their starts; an empty line may share its start with the next text's first line
    line = np.searchsorted(l_starts, starts, side="right") - 1
    l_words = np.bincount(line, minlength=k)
    full = np.flatnonzero(l_words > 0)
    keys = [textvec.Prefixes(raw, lane).ranges(l_starts[full], l_ends[full]) if lane else prefix.ranges(l_starts[full], l_ends[full]) for lane in (0, 1)]
    out["n_dup_lines"] = np.bincount(l_doc[full][_seen_before(l_doc[full], *keys)], minlength=n)

    share = lambda which: np.bincount(line[which], minlength=k) / np.maximum(l_words, 1)
    last, before = raw[ends - 1], raw[np.maximum(ends - 2, 0)]
    wide = ends - starts > 1
    marked = wide & (last == before) & (_SYMBOL[last] | (last == ord("!")) | (last == ord("?")))
    separator = (ends - starts == 1) & _SEPARATOR[last]
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    closed = np.zeros(k, bool)
    final = np.searchsorted(line, full, side="right") - 1
    closed[full] = _ASCII_END[last[final]]
    unsure = full[(last[final] >= 0x80)]
    for i, e in zip(unsure.tolist(), ends[final[last[final] >= 0x80]].tolist(), strict=True):
        closed[i] = bool(_WIDE_END.search(raw[max(0, e - 3) : e].tobytes()))
    boiler = np.zeros(k, bool)
    found = [m.start() for m in _BOILER.finditer(raw.tobytes())]
    boiler[np.searchsorted(l_starts, np.array(found, np.int64), side="right") - 1] = True
    failed = (share(marked) > MAX_MARKED) | (share(separator) > MAX_SEPARATORS) | (share(stutter) > MAX_STUTTER)
    failed |= (~closed & (l_words < MIN_OPEN_WORDS)) | (boiler & (l_words <= MAX_BOILER_WORDS))
    failed &= l_words > 0
    l_chars = np.bincount(line, chars, k).astype(np.int64)
    out["n_lines"] = np.bincount(l_doc, minlength=n)
    out["n_failed_lines"] = np.bincount(l_doc[failed], minlength=n)
    out["lost_chars"] = np.bincount(l_doc[failed], l_chars[failed], n).astype(np.int64)
    first, after = np.zeros(k, np.int64), np.zeros(k, np.int64)
    first[full], after[full] = starts[np.searchsorted(line, full)], ends[final]
    masked = textvec.ascii_lower(raw)
    masked[(masked >= ord("0")) & (masked <= ord("9"))] = ord("0")
    each = {"doc": l_doc, "number": np.arange(k) - np.searchsorted(l_doc, l_doc), "chars": l_chars, "failed": failed, "size": after - first}
    each["open"] = ~failed & (l_words > 0) & (l_words <= MAX_BOILER_WORDS)
    for lane, name in enumerate(("key", "check")):
        each[name] = textvec.Prefixes(masked, lane).ranges(first, after).view(np.int64)
    return out, each


def _lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.Array:
    """values of texts in order as one list for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def _measure(column: pa.Array) -> pa.StructArray:
    raw, offsets = textvec.column_bytes(column)
    n = len(column)
    counts, each = measure(raw, offsets)
    # the longest line, the first of those; a text without a word has none
    order = np.lexsort((each["number"], -each["size"], each["doc"]))
    top = order[np.searchsorted(each["doc"][order], np.arange(n))]
    main = pa.array(each["key"][top], pa.int64(), mask=counts["n_words"] == 0)
    may = np.flatnonzero(each["open"])
    fields = [pa.array(each["number"][may], pa.int32()), *(pa.array(each[c][may], pa.int64()) for c in ("key", "check", "chars"))]
    lines = pa.StructArray.from_arrays(fields, names=[f.name for f in OPEN.elementType])
    bad = np.flatnonzero(each["failed"])
    arrays = [main, _lists(lines, each["doc"][may], n), _lists(pa.array(each["number"][bad], pa.int32()), each["doc"][bad], n)]
    return pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS] + arrays, names=[f.name for f in MEASURES])


def line_measures(text: Column) -> Column:
    """A struct of counts, the longest line's hash, lines that passed and numbers of lines that failed; null counts as empty.

    A line fails if over 30 % of its words end in a doubled mark, over 10 % are separators, or over 30 % equal the
    word before; if it has fewer than eight words and no end mark; or if it is short and holds a phrase that web pages
    repeat. Lines without a word neither fail nor count as equal.
    """

    @F.arrow_udf(MEASURES)
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield in_slices(column, _measure)

    return measures(text.cast("string"))


def shared_lines(measured: DataFrame) -> DataFrame:
    """source, key and check of boilerplate: lines that many different documents of a source share.

    measured: source and m (line_measures). Sources may be null, which is one source. Counts are over all documents;
    what a source or a line repeats is combined before it is shuffled.
    """
    texts = measured.select("source", "m.main").filter("main is not null").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    texts = texts.filter(F.col("documents") >= SHARED_DOCUMENTS).withColumnRenamed("source", "s_source")
    lines = measured.select("source", "m.main", F.explode("m.open").alias("o")).select("source", "main", "o.key", "o.check").distinct()
    counts = lines.groupBy("source", "key", "check").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_DOCUMENTS)
    enough = F.col("source").eqNullSafe(F.col("s_source")) & (100 * F.col("n") >= SHARED_PERCENT * F.col("documents"))
    return counts.join(texts, enough).select("source", "key", "check")


def _shared_in(measured: DataFrame) -> DataFrame:
    """row, n, chars and numbers of the shared lines of each row that holds some. measured: row, source, m."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt")
    shared = shared_lines(measured).select(F.col("source").alias("r_source"), F.col("key").alias("r_key"), F.col("check").alias("r_check"), salts)
    lines = measured.select("row", "source", F.explode("m.open").alias("o"), F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"))
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("o.key") == F.col("r_key")) & (F.col("o.check") == F.col("r_check")) & (F.col("salt") == F.col("r_salt"))
    found = lines.join(shared, same).groupBy("row")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("o.chars").alias("chars"), F.collect_list("o.line").alias("numbers")).withColumnRenamed("row", "r_row")


def _judged(measured: DataFrame, row: str, source: str, m: str, h: str) -> tuple[DataFrame, list[Column], Column]:
    """measured with its shared lines in ``h``, the counts and verdicts as columns, and the numbers of failed lines.

    measured: a written table; ``row`` numbers its rows, ``m`` holds their measures.
    """
    shared = _shared_in(measured.select(F.col(row).alias("row"), F.col(source).alias("source"), F.col(m).alias("m")))
    shared = shared.select(F.col("r_row").alias(f"{h}_row"), F.struct("n", "chars", "numbers").alias(h))
    out = measured.join(shared, F.col(row) == F.col(f"{h}_row"), "left").drop(f"{h}_row")
    count = {c: F.col(f"{m}.{c}") for c in COUNTS}
    count["n_failed_lines"] = count["n_failed_lines"] + F.coalesce(F.col(f"{h}.n"), F.lit(0))
    count["lost_chars"] = count["lost_chars"] + F.coalesce(F.col(f"{h}.chars"), F.lit(0))
    base = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
    kept = ~base & (count["lost_chars"] <= MAX_LOST * count["word_chars"])
    gone = F.concat(F.col(f"{m}.failed"), F.coalesce(F.col(f"{h}.numbers"), F.array().cast("array<int>")))
    return out, [*(c.alias(name) for name, c in count.items()), base.alias("base_failed"), kept.alias("kept")], gone


def without_lines(text: Column, numbers: Column) -> Column:
    """text without the lines of these numbers (from 0, in any order); null for null."""

    @F.arrow_udf(T.StringType())
    def cut_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, numbers in enumerate(gone.to_pylist()):
            if out[i] is not None and numbers:
                failed = set(numbers)
                out[i] = "\n".join(line for k, line in enumerate(out[i].split("\n")) if k not in failed)
        return textvec.strings(out)

    return cut_lines(text.cast("string"), numbers)


def clean_documents(docs: DataFrame, text_col: str = "text", name: str = "rules", source_col: str = "source") -> DataFrame:
    """The columns of docs and a struct ``name`` with counts, verdicts and the cleaned text, one row for each row.

    base_failed, and so not kept: fewer than 20 words, or over 30 % of the words in 8-word windows that the text holds
    twice or more. Other texts are kept unless their failed lines hold over 40 % of the characters in words. A line
    fails by the rules for single lines (line_measures), or if at most 40 words long and shared: by 10 or more different
    documents of its source that are 1 % of them or more. clean_text is the text without its failed lines (null for
    null). Null texts count as empty, null sources as one source; equal rows are judged alike.
    A column of docs called like ``name`` is an error."""
    require_free(docs, name)
    row, m, h = (free_name(docs, c) for c in ("row", "m", "h"))
    # rows are numbered as the table is written, and keep their numbers
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(m, line_measures(F.col(text_col)))
    out, verdicts, gone = _judged(materialise(numbered, "line-measures"), row, source_col, m, h)
    return out.select(*docs.columns, F.struct(*verdicts, without_lines(F.col(text_col), gone).alias("clean_text")).alias(name))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and both verdicts of every document; all columns but doc_id, source and text are ignored.

    Texts are read once; what is written and shuffled are counts and hashes of short lines."""
    rows = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), line_measures(F.col("text")).alias("m"))
    out, verdicts, _ = _judged(materialise(rows, "line-measures"), "row", "source", "m", "h")
    return out.select("doc_id", *verdicts)
