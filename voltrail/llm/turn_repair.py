"""Conversation structure repair by a grammar-compressed dynamic program.

Each row of a conversation is a symbol: the class of its role and whether it must go or is cut off. The symbols of a
conversation, in order, form pieces of bounded length. Re-Pair over all pieces replaces the most frequent adjacent pairs
by rules, a number of pairs a round. A symbol has a min-plus transfer matrix: for each pair of states of the role pattern
``(s?(ua)+)?`` the cheapest edits that lead from one to the other, with their audit as a rope. A rule's matrix is the
product of its two parts', so it is evaluated once, bottom-up, and serves every conversation that holds it. A piece's matrix is
the product of its symbols'; the pieces' matrices are multiplied in order for each conversation.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert a user or assistant
turn with empty text 3; a truncated row that isn't deleted adds 3. Of equally cheap audits the least in ASCII order is taken.
An audit's cost follows from its letters, so no audit is a proper prefix of an equally cheap one, and the least audit of a
whole consists of least audits of its parts.

A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that isn't white space is none of ``.!?``).

Defined cases: null roles and texts count as one space, so such a text is blank and such a role is none of the known
ones; rows with a null conversation id form one conversation; null turns come first; equal turns are ordered by role and text as they are
after damage, so repeated rows stand side by side and all but one of them are duplicates; a role counts by its first character, an empty one by none;
a conversation that damage leaves without rows has zeros, an empty audit and the digest of the empty string; an empty table gives an
empty table; other columns are not read. Texts may have any length; a conversation may have any number of rows: only its audit is held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import stored

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States of the role pattern: nothing yet, after s, after u, after a; where a conversation may end; the state that a role leads to.
STATES, ENDS = 4, (0, 3)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
CLASSES = "sua"
#: Symbols: 0 must go; 1 + 2 * class (3: another role) + 1 if it is cut off.
TERMINALS = 9
#: Symbols of a piece at most; rules of the grammar, and pairs replaced a round.
PIECE, RULES, ROUND = 4096, 256, 32
_APART = np.uint16(0xFFFF)
_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Rope:
    """A text made of two others, with its length and a hash of its characters, so that shared parts are stored once."""

    __slots__ = ("length", "hash", "text", "left", "right")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.length = len(text)
            self.hash = reduce(lambda h, c: (h * _BASE + c + 1) % _MOD, text.encode("ascii"), 0)
        else:
            self.length = left.length + right.length
            self.hash = (left.hash * pow(_BASE, right.length, _MOD) + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not other.length:
            return self
        return Rope(None, self, other) if self.length else other

    def __str__(self) -> str:
        out, left = [], [self]
        while left:
            r = left.pop()
            if r.text is None:
                left += (r.right, r.left)
            else:
                out.append(r.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """By characters; equal parts at equal places are passed over by their hashes."""
        x, y = [(self, 0)], [(other, 0)]
        while x and y:
            (a, i), (b, j) = x.pop(), y.pop()
            if not i and not j and a.length == b.length and a.hash == b.hash:
                continue
            if a.text is None and (a.length >= b.length or b.text is not None):
                x += ((a.right, 0), (a.left, 0))
                y.append((b, j))
            elif b.text is None:
                y += ((b.right, 0), (b.left, 0))
                x.append((a, i))
            else:
                n = min(a.length - i, b.length - j)
                p, q = a.text[i : i + n], b.text[j : j + n]
                if p != q:
                    return p < q
                if i + n < a.length:
                    x.append((a, i + n))
                if j + n < b.length:
                    y.append((b, j + n))
        return bool(y)


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]
_LETTERS = {c: Rope(c) for c in "KRDI"}
_EMPTY = Rope("")


def _less(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a if b is None else b
    return min(a, b)  # by cost, then by audit


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; of equal costs the least audit."""
    out: Matrix = [[None] * len(b[0]) for _ in a]
    for i, row in enumerate(a):
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        cost, have = x[0] + y[0], out[i][j]
                        if have is None or cost <= have[0]:
                            out[i][j] = _less(have, (cost, x[1] + y[1]))
    return out


def identity() -> Matrix:
    return [[(0, _EMPTY) if i == j else None for j in range(STATES)] for i in range(STATES)]


def insertions() -> Matrix:
    """Any number of insertions; two suffice from each state to each that they reach."""
    one: Matrix = [[None] * STATES for _ in range(STATES)]
    for role in "ua":
        for i, j in STEPS[role].items():
            one[i][j] = (INSERT, _LETTERS["I"])
    two = product(one, one)
    return [[_less(_less(identity()[i][j], one[i][j]), two[i][j]) for j in range(STATES)] for i in range(STATES)]


def terminal(symbol: int) -> Matrix:
    """Insertions, then the edits of one row."""
    edits: Matrix = [[(DELETE, _LETTERS["D"]) if i == j else None for j in range(STATES)] for i in range(STATES)]
    if symbol:
        own, extra = (symbol - 1) // 2, CUT_OFF * ((symbol - 1) % 2)
        ways = [(r, REROLE + extra, "R") for r in "ua"] + ([(CLASSES[own], KEEP + extra, "K")] if own < 3 else [])
        for role, cost, letter in ways:
            for i, j in STEPS[role].items():
                edits[i][j] = _less(edits[i][j], (cost, _LETTERS[letter]))
    return product(insertions(), edits)


class Grammar:
    """The matrices of the terminals and of the rules, each rule's from its two parts."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.matrices = [terminal(s) for s in range(TERMINALS)]
        for left, right in rules:
            self.matrices.append(product(self.matrices[left], self.matrices[right]))
        self.known: dict[bytes, tuple[list[int | None], list[str | None]]] = {}

    def fold(self, symbols: Iterable[int]) -> Matrix:
        """The product of the symbols' matrices, in halves, so that ropes stay shallow."""
        level = [self.matrices[s] for s in symbols] or [identity()]
        while len(level) > 1:
            level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def transfers(self, several: list[bytes]) -> list[tuple[list, list]]:
        """Of each piece: costs and audits from each state to each, null where there is no way."""
        new = [p for p in dict.fromkeys(several) if p not in self.known]
        if len(self.known) + len(new) > 20_000:
            self.known.clear()
            new = list(dict.fromkeys(several))
        coded, ends = compressed(new, self.rules)
        for p, a, b in zip(new, [0, *ends], ends):
            flat = [e for row in self.fold(coded[a:b][coded[a:b] != _APART].tolist()) for e in row]
            self.known[p] = [e and e[0] for e in flat], [e and str(e[1]) for e in flat]
        return [self.known[p] for p in several]


def compressed(several: list[bytes], rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces in a row, a mark after each, with the rules applied in order; and the places behind the marks."""
    codes = np.frombuffer(b"\xff".join([*several, b""]), np.uint8).astype(np.uint16)
    codes[codes == 0xFF] = _APART
    for i, (left, right) in enumerate(rules):
        at = pairs_at(codes, left, right)
        if len(at):
            codes[at] = TERMINALS + i
            codes = np.delete(codes, at + 1)
    return codes, np.flatnonzero(codes == _APART) + 1


def pairs_at(codes: np.ndarray, left: int, right: int) -> np.ndarray:
    """Where the pair begins; of overlapping places, every second one from the left."""
    at = np.flatnonzero((codes[:-1] == left) & (codes[1:] == right))
    if left == right and len(at):
        runs = np.append(True, np.diff(at) != 1)
        first = at[runs][np.cumsum(runs) - 1]
        at = at[(at - first) % 2 == 0]
    return at


def learnt(pieces: DataFrame, rules: int = RULES, a_round: int = ROUND) -> list[tuple[int, int]]:
    """Re-Pair over all pieces (symbols, n: how often they occur). Each round counts the adjacent pairs of what is left and
    makes rules of the most frequent ones, as long as they occur twice."""
    found: list[tuple[int, int]] = []
    while len(found) < rules:
        shared = pieces.sparkSession.sparkContext.broadcast(list(found))  # at most so many pairs of numbers

        def count(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, ends = compressed(batch.column("symbols").to_pylist(), shared.value)
                if not len(codes):
                    continue
                often = np.repeat(batch.column("n").to_numpy(), np.diff(np.append(0, ends)))[:-1]
                both = (codes[:-1] != _APART) & (codes[1:] != _APART)
                same = both & (codes[:-1] == codes[1:])  # of a run, every second place counts
                starts = np.flatnonzero(same & ~np.append(False, same[:-1]))
                run = starts[np.cumsum(np.isin(np.arange(len(same)), starts)) - 1] if len(starts) else np.zeros(len(same), np.int64)
                both &= ~same | ((np.arange(len(same)) - run) % 2 == 0)
                key, which = np.unique(codes[:-1][both].astype(np.int64) << 16 | codes[1:][both], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(which, often[both], len(key)).astype(np.int64))], ["pair", "n"])

        counted = pieces.select("symbols", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = counted.orderBy(F.desc("n"), "pair").limit(min(a_round, rules - len(found))).collect()
        if not best:
            break
        found += [(r["pair"] >> 16, r["pair"] & 0xFFFF) for r in best]
    return found


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's key decides: 0 of 20 drops it, 1 empties its text, 2 removes
    its full stops, question and exclamation marks, 3 repeats it, 4 makes the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role, text = blank("role"), blank("text")
    out = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("again")).drop("again")


def in_order(df: DataFrame) -> DataFrame:
    """Stored rows with their place among all (by conversation, turn, role and text), a key for each role and text of a
    conversation, and what the row alone tells: its class (s, u, a, or another) and whether it is blank or cut off."""
    text, space = F.col("text"), r"\x20\x09-\x0D"
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    sorted_ = df.withColumn("head", F.substring("text", 1, 32)).repartitionByRange(*keys, "head").drop("head").sortWithinPartitions(*keys, "text")
    one = sorted_.withColumn("place", F.monotonically_increasing_id())
    same = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role").cast("string"), F.concat("role", "text")))
    return stored(
        one.select(
            "place", "conv_id", "turn", "role", "text", F.unhex(same).alias("same"), F.substring("role", 1, 1).alias("initial"),
            (~text.rlike(f"[^{space}]")).alias("blank"), (~text.rlike(rf"[.!?][{space}]*\z")).alias("cut_off"),
        ),
        "turns",
    )


def duplicates(turns: DataFrame) -> DataFrame:
    """The places of rows whose role and text came earlier in their conversation. Copies are counted before they are shuffled."""
    firsts = turns.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return turns.where("NOT blank").select("same", "place").join(firsts, "same").where("place > first").select("place")


def pieces(turns: DataFrame, again: DataFrame) -> DataFrame:
    """conv_id, place (of the first row) and symbols of each piece: rows of one conversation, side by side in one task."""
    known = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("initial")), F.lit(0))
    own = F.when(known > 0, known - 1).otherwise(F.lit(3))
    symbol = F.when(F.col("blank") | F.col("again"), 0).otherwise(1 + 2 * own + F.col("cut_off").cast("int"))
    rows = turns.join(again.withColumn("again", F.lit(True)), "place", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    rows = rows.select("conv_id", "place", symbol.cast("int").alias("symbol")).repartitionByRange("place").sortWithinPartitions("place")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a conversation that goes on in the next batch gets another piece
            conv, n, at = batch.column("conv_id").to_pylist(), batch.column("symbol").to_numpy().astype(np.uint8).tobytes(), 0
            begins, parts = [], []
            for _, group in groupby(conv):
                stop = at + sum(1 for _ in group)
                cuts = range(at, stop, PIECE)
                begins += cuts
                parts += [n[c : min(c + PIECE, stop)] for c in cuts]
                at = stop
            take = pa.array(begins, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(take), batch.column("place").take(take), pa.array(parts, pa.binary())], ["conv_id", "place", "symbols"])

    return rows.mapInArrow(run, f"conv_id {kind}, place long, symbols binary")


_grammars: dict[tuple, Grammar] = {}


def _grammar(rules: list[tuple[int, int]]) -> Grammar:
    key = tuple(rules)
    if key not in _grammars:
        _grammars.clear()
        _grammars[key] = Grammar(rules)
    return _grammars[key]


def audits(parts: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """conv_id, cost and audit of the cheapest edits: the pieces' matrices where the pieces are, then their products by conversation."""
    shared = parts.sparkSession.sparkContext.broadcast(rules)  # at most so many pairs of numbers
    kind = parts.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                found = _grammar(shared.value).transfers(b.column("symbols").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([a for _, a in found], pa.list_(pa.string()))], ["conv_id", "place", "costs", "audits"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, now, row = _grammar(shared.value), (), None
        schema = pa.schema([b for b in (("conv_id", None), ("cost", pa.int64()), ("audit", pa.string())) if b[1]])

        def closed() -> list:
            last = product([row], insertions())[0]
            cost, audit = reduce(_less, (last[i] for i in ENDS))
            return [cost, str(audit)]

        for batch in batches:
            ids, done = [], []
            for conv, costs, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "costs", "audits"))):
                if now != (conv,):
                    if now:
                        ids.append(now[0])
                        done.append(closed())
                    now, row = (conv,), identity()[0]
                matrix = [[None if costs[i] is None else (costs[i], Rope(texts[i])) for i in range(k, k + STATES)] for k in range(0, STATES * STATES, STATES)]
                row = product([row], matrix)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("conv_id").type), *(pa.array([d[i] for d in done], schema[i].type) for i in (0, 1))], ["conv_id", "cost", "audit"])
            last = batch.column("conv_id").type
        if now:
            cost, audit = closed()
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], last), pa.array([cost], pa.int64()), pa.array([audit])], ["conv_id", "cost", "audit"])

    matrices = parts.select("conv_id", "place", "symbols").mapInArrow(each, f"conv_id {kind}, place long, costs array<long>, audits array<string>")
    ordered = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "costs", "audits")
    return ordered.mapInArrow(joined, f"conv_id {kind}, cost long, audit string")


def repaired_turns(rows: Iterable[tuple[str, str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows, from the rows (role, initial, text) in order and the audit. Roles after an
    optional s alternate, so the audit alone tells what an inserted or reroled turn is."""
    turn, left = 0, iter(audit)
    for role, initial, text in rows:
        letter = next(left)
        while letter == "I":
            yield ("user", "assistant")[turn], ""
            turn ^= 1
            letter = next(left)
        if letter == "K":
            yield role, text
            turn ^= initial != "s"
        elif letter == "R":
            yield ("user", "assistant")[turn], text
            turn ^= 1
    for _ in left:
        yield ("user", "assistant")[turn], ""
        turn ^= 1


#: What is reported of a conversation besides its id.
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(turns: DataFrame, again: DataFrame, found: DataFrame) -> DataFrame:
    """The report of each conversation that has rows. A conversation's audit comes first, then its rows in order, each after a
    mark if it is a duplicate; they stream through a task, and only the audit is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "place", "kind", "cost", "turn", "role", "initial", "text", "blank", "cut_off"]
    empty = {"cost": "long", "turn": "long", "role": "string", "initial": "string", "text": "string", "blank": "boolean", "cut_off": "boolean"}
    fill = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(empty[c]).alias(c) for c in columns))
    head = found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("kind"), "cost", F.col("audit").alias("text"))
    marks = turns.select("conv_id", "place").join(again, "place").withColumn("kind", F.lit(1))
    stream = fill(head).unionByName(fill(marks)).unionByName(fill(turns.withColumn("kind", F.lit(2))))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")

    def events(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    def one(conv, events: Iterator[tuple]) -> tuple:
        _, _, _, cost, *_, audit, _, _ = next(events)
        n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = last = None
        again = False

        def rows() -> Iterator[tuple[str, str, str]]:
            nonlocal low, high, last, again
            for _, _, kind, _, turn, role, initial, text, blank, cut_off in events:
                if kind == 1:
                    again = True
                    continue
                if turn is not None and turn != high:
                    low, high = turn if low is None else low, turn
                    n["turns"] += 1
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut_off else None
                if fault:
                    n[fault] += 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    n["illegal"] += 1
                last, again = initial, False
                yield role, initial, text

        digest, first = hashlib.sha256(), True
        for role, text in repaired_turns(rows(), audit):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        gaps = 0 if low is None else high - low + 1 - n["turns"]
        return conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, digest.hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["conv_id", *(x.split()[0] for x in REPORT.split(", "))])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        conv_type = first.column("conv_id").type

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        done: list[tuple] = []
        for conv, group in groupby(events(all_batches()), key=lambda e: e[0]):
            done.append(one(conv, group))
            if len(done) >= 2000:
                yield out(done)
                done = []
        yield out(done)

    return stream.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repair(df: DataFrame) -> DataFrame:
    """Per conversation of df (conv_id, turn, role, text), without damage: the faults and the cheapest repair of the rows as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return _repair(df.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")))


def _repair(rows: DataFrame) -> DataFrame:
    turns = in_order(rows)
    again = stored(duplicates(turns), "duplicate-turns")
    parts = stored(pieces(turns, again), "turn-pieces")
    shapes = stored(parts.groupBy("symbols").agg(F.count("*").alias("n")), "turn-shapes")
    return reported(turns, again, audits(parts, learnt(shapes)))


def repaired(df: DataFrame) -> DataFrame:
    """op13: the conversations after damage, repaired; those of which nothing is left too."""
    found = _repair(damaged(df))
    whole = df.select(F.col("conv_id").alias("id")).distinct().join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    nothing: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    names = [x.split()[0] for x in REPORT.split(", ")]
    return whole.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in names))


def _sql() -> str:
    """DuckDB SQL for ``repaired``: the plain dynamic program, row by row."""
    add = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    more = {i: f"x[{i + 1}]" for i in range(4)}
    more[2] = least("x[3]", *(add(f"x[{i}]", INSERT, "I") for i in (1, 2, 4)))
    more[3] = least("x[4]", add("x[3]", INSERT, "I"), *(add(f"x[{i}]", 2 * INSERT, "II") for i in (1, 2)))
    own = lambda role: f"(CASE WHEN must THEN 1000000000 WHEN initial = '{role}' THEN {CUT_OFF} * cut ELSE 1000000000 END)"
    other = f"(CASE WHEN must THEN 1000000000 ELSE {REROLE} + {CUT_OFF} * cut END)"
    stay = lambda i: add(f"y[{i}]", DELETE, "D")
    to = lambda role, *froms: [add(f"y[{i}]", own(role), "K") for i in froms] + ([add(f"y[{i}]", other, "R") for i in froms] if role != "s" else [])
    after = f"[{stay(1)}, {least(stay(2), *to('s', 1))}, {least(stay(3), *to('u', 1, 2, 4))}, {least(stay(4), *to('a', 3))}]"
    end = least("x[1]", "x[4]", add("x[3]", INSERT, "I"), *(add(f"x[{i}]", 2 * INSERT, "II") for i in (1, 2)))
    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    return rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations AS c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
hit AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS d FROM keyed),
rows_ AS (SELECT g, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE d WHEN 3 THEN 2 ELSE 1 END) WHERE d <> 0),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
marked AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended FROM numbered),
faults AS (SELECT *, blank OR nth > 1 AS must, (NOT ended)::INT AS cut FROM marked),
walk AS (
  SELECT g, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': ''}}, {none}, {none}, {none}] AS x FROM ids
  UNION ALL
  SELECT g, i, {after} FROM (
    SELECT w.g, f.i, must, cut, initial, [{", ".join(more[i] for i in range(4))}] AS y
    FROM walk AS w JOIN faults AS f ON f.g = w.g AND f.i = w.i + 1)),
best AS (SELECT g, e.c AS cost, e.a AS audit FROM (SELECT g, {end} AS e FROM (SELECT g, arg_max(x, i) AS x FROM walk GROUP BY g))),
letters AS (SELECT g, p, audit[p] AS letter FROM best, unnest(range(1, length(audit) + 1)) AS u(p)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY g ORDER BY p)),
made AS (SELECT p.g, o, letter, role, text, initial, bool_or(o = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY p.g) AS led
  FROM placed AS p LEFT JOIN faults AS f ON f.g = p.g AND f.i = p.i AND letter <> 'I' WHERE letter <> 'D'),
texts AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY o) AS t FROM made GROUP BY g),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (NOT must AND cut = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair FROM faults) GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN best USING (g) LEFT JOIN counts USING (g) LEFT JOIN texts USING (g)"""


ORACLE = _sql()
