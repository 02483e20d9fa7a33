"""Repair of conversations whose turns are lost, repeated, cut or given to the wrong role.

A conversation's rows make a signature, a letter for each row: its role's initial and its fault. All signatures are sorted
by their reverse, so that those with a common ending stand together, and walked as one automaton whose nodes are the
different endings: an ending shared by any number of conversations is a node once. Nodes that cost the same from every
state of the grammar, but for a constant, are one class, and the edge of a class and a letter is worked out once: what
each state of the grammar pays from there on, and the best edits. A node's best audit suffix for a state is the edge's
edits in front of a suffix that the next node holds already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import bound_batches, drop_path, materialise, materialise_at

#: What edits cost: keep, rerole, delete, insert; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of signatures: initials s, u, a and any other; in lower case for sound rows, in upper case for truncated ones,
#: as digits for rows that must go.
LETTERS = "suaxSUAX0123"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What an initial leads to, the role that a
#: rerole or an insert gives and where it leads, and what the end still takes.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
END = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"


# ---- damage and faults ----


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the number of equal rows after damage, which is 0 for rows that are dropped.

    A null role or text is one space. crc32(``conv_id:turn``, a null as one space) modulo 20 decides: 0 drops a row, 1
    empties its text, 2 takes the end marks out of it, 3 repeats it, 4 gives it to the user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(lot == 1, "").when(lot == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(lot == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("n"))
    return each.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """rows (as damage gives them) with ``fault`` of the first of n equal rows (blank, duplicate, truncated or none),
    ``blank`` for all of them, and the role's ``initial`` (x for none of s, u and a).

    A row is a duplicate if its conversation has its role and text in an earlier turn; of equal rows all but the first are.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("blank", blank).withColumn("cut", cut).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))
    alive = rows.filter("n > 0")
    # nulls come first: a flag stands before the turn
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = alive.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < turn, "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    return joined.select("conv_id", "turn", "role", "text", "n", "initial", "blank", fault.alias("fault"))


def _pieces(rows: DataFrame) -> DataFrame:
    """conv_id, part and piece of the signature: rows are cut into ranges of (conversation, turn, role, text), so that a
    long conversation is dealt to many tasks."""
    order = ("conv_id", "turn", "role", "text")
    place = F.instr(F.lit("suax"), F.col("initial")) - 1
    letter = F.when(F.col("fault") == "none", "suax").when(F.col("fault") == "truncated", "SUAX").otherwise("0123")
    first = F.substring(letter, place + 1, F.lit(1))
    letters = F.concat(first, F.repeat(F.substring(F.lit("0123"), place + 1, F.lit(1)), F.col("n").cast("int") - 1))
    ranged = rows.filter("n > 0").select(*order, letters.alias("letters")).repartitionByRange(*order).sortWithinPartitions(*order)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for conv, more in zip(batch.column("conv_id").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append((held[0], "".join(held[1])))
                    held = (conv, [])
                held[1].append(more)
            if len(out) > 10_000:
                yield rows_of(out, part)
                out = []
        if held is not None:
            out.append((held[0], "".join(held[1])))
        yield rows_of(out, part)

    def rows_of(out: list[tuple], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([p for _, p in out], pa.string())], names=["conv_id", "part", "piece"])

    return ranged.select("conv_id", "letters").mapInArrow(collect, "conv_id long, part int, piece string")


def conversations(rows: DataFrame) -> DataFrame:
    """Of each conversation: gaps, blank, duplicate, truncated and its signature. rows: as marked gives them; those with
    n = 0 count for nothing, but their conversation is there."""
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    fault = F.col("fault")
    later = F.coalesce(F.sum(F.when((F.col("n") > 1) & ~F.col("blank"), F.col("n") - 1)), F.lit(0))
    one = lambda name: F.coalesce(F.sum(F.when((F.col("n") > 0) & (fault == name), 1)), F.lit(0))
    turns = rows.groupBy("conv_id", "turn").agg(count(F.col("blank")).alias("blank"), (one("duplicate") + later).alias("duplicate"), one("truncated").alias("truncated"), (F.max("n") > 0).alias("alive"))
    none = lambda kind: F.lit(None).cast(kind)
    each = turns.select("conv_id", F.when(F.col("alive"), F.col("turn")).alias("turn"), "blank", "duplicate", "truncated", none("struct<part:int,piece:string>").alias("p"))
    pieces = _pieces(rows).select("conv_id", none("long").alias("turn"), *(F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")), F.struct("part", "piece").alias("p"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    signature = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "")
    return each.unionByName(pieces).groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), signature.alias("signature"))


# ---- the automaton ----


class Automaton:
    """Classes of endings by what they cost from each state of the grammar, and the edges between them."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.edges: dict[tuple[int, str], tuple[int, int, tuple[str, ...], tuple[int, ...]]] = {}
        self.end = self._class(tuple(INSERT * len(e) for e in END))

    def _class(self, costs: tuple[int, ...]) -> int:
        if costs not in self.number:
            self.number[costs] = len(self.costs)
            self.costs.append(costs)
        return self.number[costs]

    def edge(self, after: int, letter: str) -> tuple[int, int, tuple[str, ...], tuple[int, ...]]:
        """Class of the ending that begins with a letter, what is to be added to its costs, and for each state the edits
        up to and with the letter's row (ties to the least text) and the state behind it."""
        if (after, letter) not in self.edges:
            rest = self.costs[after]
            initial, fault = "suax"[LETTERS.index(letter) % 4], LETTERS.index(letter) // 4

            def row(q: int) -> Iterator[tuple[int, str, int]]:
                yield DELETE + rest[q], "D", q
                if fault < 2:
                    if (to := STEP[q].get(initial)) is not None:
                        yield fault * TRUNCATED + rest[to], "K", to
                    yield REROLE + fault * TRUNCATED + rest[GIVEN[q][1]], "R", GIVEN[q][1]

            best = []
            for q in range(len(STEP)):
                choices, at = [], q
                for inserts in range(3):
                    choices += [(INSERT * inserts + c, "I" * inserts + e, to) for c, e, to in row(at)]
                    at = GIVEN[at][1]
                best.append(min(choices))
            low = min(c for c, _, _ in best)
            self.edges[after, letter] = (self._class(tuple(c - low for c, _, _ in best)), low, tuple(e for _, e, _ in best), tuple(to for _, _, to in best))
        return self.edges[after, letter]

    def repairs(self, signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
        """Signature, cost and audit of each, for signatures in order of their reverse."""
        # a node: class, costs to add, and for each state the edits and the node's suffix behind them
        chain = [(self.end, 0, tuple((e, None) for e in END))]
        before = ""
        for signature in signatures:
            letters = signature[::-1]
            same = 0
            for a, b in zip(letters, before):
                if a != b:
                    break
                same += 1
            del chain[same + 1 :]
            for letter in letters[same:]:
                after, more, tails = chain[-1]
                number, low, edits, states = self.edge(after, letter)
                chain.append((number, more + low, tuple((e, tails[to]) for e, to in zip(edits, states, strict=True))))
            number, more, tails = chain[-1]
            audit, tail = [], tails[0]
            while tail is not None:
                audit.append(tail[0])
                tail = tail[1]
            yield signature, more + self.costs[number][0], "".join(audit)
            before = letters


def illegal(signature: str) -> int:
    """Adjacent rows whose initials no conversation has."""
    initials = signature.translate(str.maketrans(LETTERS, "suax" * 3))
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repairs(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit and illegal of each different signature. signatures: signature. Ranges of reversed
    signatures are walked by a task each; only the endings on the seam of two ranges are worked out twice."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        solved = automaton.repairs(s for batch in batches for s in batch.column("signature").to_pylist())
        out: list[tuple] = []
        size = 0
        for row in solved:
            out.append((*row, illegal(row[0])))
            size += 2 * len(row[0]) + 50
            if size > 1 << 20:
                yield rows_of(out)
                out, size = [], 0
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["signature", "cost", "audit", "illegal"])

    back = F.reverse("signature")
    each = signatures.select("signature").distinct().withColumn("back", back).repartitionByRange("back").sortWithinPartitions("back")
    return each.select("signature").mapInArrow(walk, "signature string, cost long, audit string, illegal long")


# ---- results ----


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit. rows: as marked gives them, written."""
    heads = materialise(conversations(rows), "conversations")
    return heads.join(repairs(heads), "signature").drop("signature")


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _replayed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Every conversation's head in front of its rows in order, conversations whole in one task each."""
    none = lambda kind: F.lit(None).cast(kind)
    head = heads.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("n"), "audit", *_HEAD)
    body = rows.filter("n > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "n", none("string").alias("audit"), *(none("long").alias(c) for c in _HEAD))
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text")


class _Replay:
    """The rows of one repaired conversation, edit by edit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _given(self) -> str:
        role, self.state = GIVEN[self.state]
        return role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state][role[:1]]
            yield role, text
        elif edit == "R":
            yield self._given(), text


def _digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    columns = ["conv_id", *_HEAD, "audit", "repaired_sha256"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run, out = None, None, []

        def close() -> None:
            for line in run.inserts():
                add(line)
            out.append((*held, run.audit, digest.hexdigest()))

        def add(line: tuple[str, str]) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + ":".join(line)).encode())
            begun = True

        for batch in batches:
            t = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, part in enumerate(t["part"]):
                if part == 0:
                    if run is not None:
                        close()
                    held, run, digest, begun = [t[c][i] for c in ("conv_id", *_HEAD)], _Replay(t["audit"][i]), hashlib.sha256(), False
                else:
                    for _ in range(t["n"][i]):
                        for line in run.row(t["role"][i], t["text"][i]):
                            add(line)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in out], schema=kind)
                out.clear()
        if run is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in out], schema=kind)

    kind = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in columns])
    return _replayed(rows, heads).mapInArrow(replay, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in kind))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the rows of every repaired conversation. rows: as damage gives them."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, run, place, out = None, None, 0, []

        def add(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in lines:
                out.append((conv, place, role, text))
                place += 1

        for batch in batches:
            for c, part, role, text, n, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "n", "audit")), strict=True):
                if part == 0:
                    if run is not None:
                        add(run.inserts())
                    conv, run, place = c, _Replay(audit), 0
                else:
                    for _ in range(n):
                        add(run.row(role, text))
            yield rows_of(out)
            out.clear()
        if run is not None:
            add(run.inserts())
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "role", "text"])

    bound_batches(rows.sparkSession)
    known = materialise(marked(rows), "marked")
    return _replayed(known, judged(known)).mapInArrow(replay, "conv_id long, place long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text; other columns are ignored. They are damaged first (see damage), then taken by turn,
    nulls first; rows of one turn follow by role and text. Rows without a conv_id are one conversation; one that has
    lost all rows is there with zeros, an empty audit and the digest of nothing. A conversation's rows pass one task in
    order to be digested, a batch at a time, as a digest is one chain; nothing else of it is gathered but a
    letter for each row.
    """
    bound_batches(rows.sparkSession)
    known, path = materialise_at(marked(damage(rows)), "marked")
    out = materialise(_digests(known, judged(known)), "repairs")
    drop_path(rows.sparkSession, path)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _crc(key: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    bits = "list_reduce(list_concat([xor(acc, b)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::BIGINT)), lambda acc, b: {bits}))"


def _oracle() -> str:
    """The report in SQL: rows are taken from the last to the first, and each state keeps its best (cost, audit, text)."""
    put = lambda cost, edit, line, q: f"{{'c': {cost} + s{q}.c, 'a': '{edit}' || s{q}.a, 't': {line} || s{q}.t}}"
    more = lambda q, to: f"{{'c': {INSERT} + b{to}.c, 'a': 'I' || b{to}.a, 't': chr(10) || '{GIVEN[q][0]}:' || b{to}.t}}"

    def row(q: int) -> str:
        role, to = GIVEN[q]
        out = [put(DELETE, "D", "''", q)]
        for initial, at in STEP[q].items():
            keep = put("tr", "K", "chr(10) || role || ':' || text", at)
            out.append(f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {keep} END")
        reroled = put(f"{REROLE} + tr", "R", f"chr(10) || '{role}:' || text", to)
        out.append(f"CASE WHEN NOT gone THEN {reroled} END")
        return f"list_sort(list_filter([{', '.join(out)}], lambda o: o IS NOT NULL))[1] AS b{q}"

    def inserted(q: int) -> str:
        return f"list_sort([b{q}, {more(q, GIVEN[q][1])}])[1]"

    # from nothing or from s, two inserts may come before a row
    state = {2: inserted(2), 3: inserted(3)}
    for q in (0, 1):
        state[q] = f"list_sort([b{q}, {{'c': {INSERT} + s.i2.c, 'a': 'I' || s.i2.a, 't': chr(10) || 'user:' || s.i2.t}}])[1]"
    end = [f"{{'c': {INSERT * len(e)}::BIGINT, 'a': '{e}', 't': '{t}'}}" for e, t in zip(END, ("", "~user:~assistant:", "~assistant:", ""), strict=True)]
    end = [e.replace("~", "' || chr(10) || '") for e in end]
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
lots AS (SELECT *, {_crc("k")} % 20 AS lot FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM lots, range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
judged AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS tr, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, {", ".join(f"{e} AS s{q}" for q, e in enumerate(end))} FROM stats
  UNION ALL SELECT conv_id, i, {", ".join(f"{'s.i%d' % q if q > 1 else state[q]} AS s{q}" for q in range(4))}
  FROM (SELECT conv_id, i, b0, b1, {{'i2': {state[2]}, 'i3': {state[3]}}} AS s FROM (SELECT j.conv_id, j.i - 1 AS i, {", ".join(row(q) for q in range(4))} FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i))),
best AS (SELECT conv_id, s0 FROM walk WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


REPAIR_SQL = _oracle()
