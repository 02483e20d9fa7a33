"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one last token is possible: a vocabulary entry that ends the prefix and is
compatible with the last token of what stands before it. Matches come from an automaton over the vocabulary,
compatibility from undoing both tokens' merges at their border; back-pointers then give the ids. No merge is
ever carried out. The tokenizer's file is a parameter; words repeat, so a worker keeps the ids of words it met.

The automaton is the suffix automaton of all entries. After reading a prefix it stands on the longest suffix of it
that lies anywhere in an entry. Every entry that ends the prefix is such a suffix, so it is that place or further up
its chain of suffix links; the chain is walked from entry to entry, longest first, and the pair test keeps the one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import require_free, trim

#: Words and pairs that a worker remembers before it starts anew.
MAX_WORDS, MAX_PAIRS = 120_000, 200_000
#: Stands for the end of a word in the automaton; no byte is written as it.
END = "\ue000"
RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

#: Texts of ASCII and Latin-1 letters alone are in normal form already and are split by the standard library.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of a list of words, one state for those that end at the same places of the same words.

    A word also ends where it stands alone, and nothing longer does, so it is the longest string of its state.
    ``word`` holds the word of a state (-1: none), ``size`` the length of the longest string, ``link`` the state of
    the longest suffix that ends elsewhere too, ``above`` the nearest state up the links that has a word (0: none).
    """

    def __init__(self, words: list[str]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.link, self.size, self.word = [-1], [0], [-1]
        for i, text in enumerate(words):
            state = 0
            for letter in text:
                state = self._step(state, letter)
            self.word[state] = i
        self.above = [0] * len(self.go)
        for state in sorted(range(1, len(self.go)), key=self.size.__getitem__):
            up = self.link[state]
            self.above[state] = up if self.word[up] >= 0 else self.above[up]
        # the length at which a state has its word
        self.full = [n if w >= 0 else -1 for n, w in zip(self.size, self.word, strict=True)]

    def _step(self, state: int, letter: str) -> int:
        """The state whose longest string is that of ``state`` and a letter more; made if there is none."""
        go, link, size = self.go, self.link, self.size
        if letter in go[state]:
            return self._alone(state, letter)
        new = self._add({}, -1, size[state] + 1)
        while state >= 0 and letter not in go[state]:
            go[state][letter] = new
            state = link[state]
        link[new] = self._alone(state, letter) if state >= 0 else 0
        return new

    def _alone(self, state: int, letter: str) -> int:
        """The state that a letter leads to, parted from the longer strings that shared it."""
        go, link, size = self.go, self.link, self.size
        old = go[state][letter]
        if size[old] == size[state] + 1:
            return old
        part = self._add(dict(go[old]), link[old], size[state] + 1)
        link[old] = part
        while state >= 0 and go[state].get(letter) == old:
            go[state][letter] = part
            state = link[state]
        return part

    def _add(self, go: dict[str, int], link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.word.append(-1)
        return len(self.go) - 1

    def endings(self, text: str) -> list[int]:
        """For each prefix of a text in turn, the state of the longest word that ends it (0: none)."""
        go, link, size, full, above = self.go, self.link, self.size, self.full, self.above
        state = length = 0
        out = []
        for letter in text:
            while (to := go[state].get(letter)) is None and state:
                state = link[state]
                length = size[state]
            if to is None:
                out.append(0)
                continue
            state, length = to, length + 1
            out.append(state if full[state] == length else above[state])
        return out


class WordTokenizer:
    """A lower-casing, word-wise tokenizer read from a ``tokenizers`` file with end-of-word marks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.texts = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self._letters = {i: c for i, c in enumerate(byte_letters())}
        self._join = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self._halves = {t: pair for pair, t in self._join.items()}
        made = list(self._join.values())
        if len(self._halves) != len(merges) or made != sorted(made):
            raise ValueError("ids of merged tokens must rise with their merges, one merge each")
        self._known: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        stands = {t: i for t, i in vocab.items() if i not in self._halves or self._stands(i)}
        ended = lambda t: t.endswith(mark) and len(t) > len(mark)
        self._automaton = SuffixAutomaton([t.removesuffix(mark) + END if ended(t) else t for t in stands])
        ids = list(stands.values())
        self._automaton.word = [ids[w] if w >= 0 else -1 for w in self._automaton.word]

    def _stands(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token: no other merge breaks up its halves' border."""
        return self._agree(*self._halves[token], token)

    def _agree(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether two tokens stand side by side in an encoding.

        Undo the later of both tokens' merges again and again; a merge across the border that would have come
        before the undone one (at the same rank, the one further left comes first) rules the pair out.
        """
        join, halves = self._join, self._halves
        while True:
            across = join.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                if left not in halves:
                    return True
                before, left = left, halves[left][1]
            else:
                if right not in halves:
                    return True
                before, right = right + 1, halves[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        known, agree, automaton = self._known, self._agree, self._automaton
        size, tokens, above = automaton.size, automaton.word, automaton.above
        if len(known) > MAX_PAIRS:
            known.clear()
        text = word + END
        # the last token of each prefix and where it begins
        last, begins = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, state in enumerate(automaton.endings(text), 1):
            while state:
                begin, token = end - size[state], tokens[state]
                if not begin:
                    last[end] = token
                    break
                if (before := last[begin]) >= 0:
                    pair = before << 32 | token
                    if (fits := known.get(pair)) is None:
                        fits = known[pair] = agree(before, token)
                    if fits:
                        last[end], begins[end] = token, begin
                        break
                state = above[state]
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = begins[at]
        return out[::-1]

    def _plain_ids(self, text: str, out: list[bytes]) -> None:
        if _PLAIN.match(text):
            found = _PLAIN_WORD.findall(text.lower())
        else:
            # letters are lowered one by one: a final sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            found = _WORD.findall(text)
        if len(self._words) > MAX_WORDS:
            self._words.clear()
        words = self._words
        for w in {w for w in found if w not in words}:
            letters = w if w.isascii() and w.isalnum() else "".join(map(self._letters.__getitem__, w.encode()))
            words[w] = np.array(self.encode_word(letters), "<u4").tobytes()
        out += [words[w] for w in found]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. Special tokens in the text keep their ids."""
        out: list[bytes] = []
        for part in self._special.split(text) if self._special and "<" in text else [text]:
            if part in self.specials:
                out.append(np.array([self.specials[part]], "<u4").tobytes())
            elif part:
                self._plain_ids(part, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens' texts with spaces between them; this tokenizer states no other way of decoding."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def round_trip(text: Column, path: str) -> Column:
    """A struct of ids (little-endian unsigned 32-bit) and the text decoded from them; null counts as empty.

    ``path`` names the tokenizer's file on every machine.
    """

    @F.arrow_udf(RESULT)
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path)
        for column in batches:
            ids = [t.encode(x or "") for x in column.to_pylist()]
            trim()
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([t.decode(x) for x in ids], pa.string())], names=RESULT.names)

    return codes(text.cast("string"))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", name: str = "bpe") -> DataFrame:
    """The columns of docs and a struct ``name`` of ids and decoded text, whole texts, one row for each row.

    A column of docs called like ``name`` is an error."""
    require_free(docs, name)
    return docs.withColumn(name, round_trip(F.col(text_col), path))


def digests(encoded: DataFrame, name: str = "bpe") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text."""
    ids, decoded = F.col(f"{name}.ids"), F.col(f"{name}.decoded")
    return encoded.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"))
