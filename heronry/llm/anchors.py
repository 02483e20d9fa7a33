"""Personal data found by anchors: one automaton pass over a text, and local parsers around what it finds.

An Aho-Corasick automaton reports at-signs, plus signs, digits, schemes and words that announce an identifier, in
one pass over the whole text. Each report starts a parser of its kind, which expands to the left and to the right as far
as the kind's grammar goes, validates what it has, and never looks at a character of its kind's earlier finds again; so
the work is linear in the text. Parsers of the base kinds give the leftmost non-overlapping matches of
their grammars: a match that fails its validation is dropped, and the search goes on behind it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import in_slices, require_free

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
# Signs of addresses, and words that announce an identifier or a secret, in the languages known here.
SCHEMES = ("://", "mailto:", "tel:", "sip:")
CUES = (
    "iban", "bic", "swift", "account", "acct", "ssn", "social security", "passport", "tax id", "customer", "member", "licence", "license", "user id", "userid", "token", "api key", "api_key", "apikey", "secret", "password", "passwd",
    "konto", "kontonummer", "reisepass", "steuernummer", "kundennummer", "ausweis", "compte", "passeport", "numéro fiscal", "cuenta", "pasaporte", "dni", "nif",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[0-9]++")
_QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WEB = re.compile(r"""[^\s<>"'`{}|\\^]++""")
_CUE_VALUE = re.compile(r"""(?:[ \t]{0,2}(?:number|no|nr|num|id|key)\b\.?)?[\s:=#"'(\[]{1,6}((?-i:[A-Z]{2}[0-9]{2}(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,3})?(?![A-Za-z0-9]))|[A-Za-z0-9](?:[_./-]?[A-Za-z0-9])++)""", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_LONGEST_SCHEME = 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@cache
def automaton() -> ahocorasick.Automaton:
    """Every anchor with the name of its parser."""
    out = ahocorasick.Automaton()
    for word, parser in [("@", "email"), ("+", "phone"), *((str(d), "digit") for d in range(10)), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        out.add_word(word, (parser, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    """True for a value of an account number's international form whose check digits fit."""
    return bool(_IBAN.fullmatch(value)) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Scan:
    """Finds of one text, and how far each kind has been searched."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.seen = dict.fromkeys(KINDS, 0)
        self.found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}

    def keep(self, kind: str, begin: int, end: int, good: bool) -> None:
        self.seen[kind] = end
        if good:
            self.found[kind].append((begin, end))

    def email(self, at: int, _: int) -> None:
        begin = at
        while begin > self.seen["email"] and self.text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.keep("email", begin, m.end(), True)

    def phone(self, at: int, _: int) -> None:
        if at >= self.seen["phone"] and (m := _PHONE.match(self.text, at)):
            self.keep("phone", at, m.end(), 9 <= len(_digits(m[0])) <= 15)

    def digit(self, at: int, _: int) -> None:
        if at >= self.seen["card"] and (m := _CARD.match(self.text, at)):
            number = _digits(m[0])
            self.keep("card", at, m.end(), 12 <= len(number) <= 19 and luhn(number))
        if at >= self.seen["ip"]:
            if m := _QUAD.match(self.text, at):
                # a part of more than three digits is at most 255 only with zeros in front
                self.keep("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()))
            else:
                self.seen["ip"] = _RUN.match(self.text, at).end()  # no later start in this run of digits does better

    def scheme(self, at: int, size: int) -> None:
        if at < self.seen["address"]:
            return
        begin, text = at, self.text
        if text.startswith("://", at):
            while begin > max(self.seen["address"], at - _LONGEST_SCHEME) and text[begin - 1] in _SCHEME:
                begin -= 1
            while begin < at and not ("a" <= text[begin].lower() <= "z"):
                begin += 1
            good = begin < at
        else:
            good = begin == 0 or not text[begin - 1].isalnum()
        if good and (m := _WEB.match(text, at + size)):
            end = at + size + len(m[0].rstrip(".,;:!?)]"))
            part = text[at + size : end]
            named = part[:1].isalnum() or part[:1] == "[" if text.startswith("://", at) else "@" in part or len(_digits(part)) >= 7
            self.keep("address", begin, end, named)

    def cue(self, at: int, size: int) -> None:
        text, end = self.text, at + size
        if end < self.seen["account"] or (at and text[at - 1].isalnum()):
            return
        if m := _CUE_VALUE.match(text, end):
            value = m[1].replace(" ", "")
            # what has the form of an account number with check digits must have the right ones
            good = iban(value) if _IBAN.fullmatch(value) else len(value) >= 4 and len(_digits(value)) >= 3
            self.keep("account", m.start(1), m.end(1), good)


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, in order; the ends are exclusive. Finds of the kinds that are not base are left
    out where they meet one of the base, and accounts where they meet an address."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    scan = Scan(text)
    parsers: dict[str, Callable[[int, int], None]] = {p: getattr(scan, p) for p in ("email", "phone", "digit", "scheme", "cue")}
    for last, (parser, size) in automaton().iter(low):
        parsers[parser](last - size + 1, size)
    taken = sorted(s for k in BASE for s in scan.found[k])
    for kind in KINDS[len(BASE) :]:
        scan.found[kind] = [s for s in scan.found[kind] if not _meets(taken, s)]
        taken = sorted(taken + scan.found[kind])
    return scan.found


def _meets(taken: list[tuple[int, int]], span: tuple[int, int]) -> bool:
    """Whether a span shares a character with one of some sorted spans (which may share characters among themselves)."""
    i = bisect_left(taken, (span[1], 0))
    return any(end > span[0] for _, end in taken[max(0, i - len(BASE) - 1) : i])


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind as listed, with commas between them."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, kind in enumerate(kinds) for a, b in found[kind]))


def personal_data(text: Column) -> Column:
    """A struct for a text column (null counts as empty): numbers of finds by kind, base_sha256 and spans.

    Base: email, ip (four numbers to 255), card (12 to 19 digits with a right check digit), phone (a plus sign and 9 to 15
    digits). Added: address (web addresses, and mail, telephone and call addresses with a scheme) and account (a value
    with three digits or more behind a word that announces it; an international account number must have right check
    digits). spans lists all, base_sha256 is the digest of the base's list. Places count code points. Texts are searched
    whole, however long.
    """

    @F.arrow_udf(SCHEMA)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield in_slices(column, _search)

    return search(text.cast("string"))


def _search(column: pa.Array) -> pa.StructArray:
    rows = []
    for text in column:
        found = find(text.as_py() or "")
        rows.append({f"n_{k}": len(found[k]) for k in KINDS} | {"base_sha256": hashlib.sha256(listed(found, BASE).encode()).hexdigest(), "spans": listed(found, KINDS)})
    return pa.array(rows, pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in SCHEMA]))


def mask(text: str) -> str:
    """The text with each find replaced by its kind in angle brackets; of finds that meet, the first stays."""
    found = find(text)
    out, at = [], 0
    for begin, _, end, kind in sorted((a, k, b, kind) for k, kind in enumerate(KINDS) for a, b in found[kind]):
        if begin >= at:
            out += [text[at:begin], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by names of kinds; a null text stays null, other columns stay."""

    @F.arrow_udf(T.StringType())
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield in_slices(column, lambda part: pa.array([None if t is None else mask(t) for t in part.to_pylist()], pa.string()))

    return docs.withColumn(text_col, replace(F.col(text_col).cast("string")))


def with_personal_data(docs: DataFrame, text_col: str = "text", name: str = "personal") -> DataFrame:
    """The columns of docs and a struct ``name`` of finds (see personal_data). A column of docs called so is an error."""
    require_free(docs, name)
    return docs.withColumn(name, personal_data(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of finds, base_sha256 and spans of every document; all columns but doc_id and text are ignored."""
    return docs.select("doc_id", personal_data(F.col("text")).alias("p")).select("doc_id", "p.*")
