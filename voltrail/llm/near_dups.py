"""Near-duplicate components by a chosen-path set similarity join over word shingles.

Documents with equal shingle sets form one class. In each of several independent trees a class branches by selected
minwise tokens; all classes with the same path so far are a node. A node with few classes compares their sketches
exhaustively. A larger one branches again, into the nodes of two further tokens for each class. What is still large at the
last level is compared in chunks and with leaders.

Of each class the likeliest partner and the partner with the smallest number are confirmed on full sets. Then the groups of
classes that sketches connect in a node, and the large nodes of the last level, are looked through for classes that
confirmed links have not brought into one component. Groups of all trees whose largest component is the same are one; in it, the classes
outside that component meet the others in blocks of bounded size: first by sketches alone, then those that sketches may link
with their full sets, the likeliest pairs first. What confirmed links connect is not looked at again, so a group of copies costs links in
proportion to its size, not to its square.

Recall: a pair at the threshold t takes the same branch with probability t. If m is its probability of missing each other
below a node, that of a node with b branches above is (1 - t + t * m) ** b, and at the roots the exponent is the number
of trees. With two branches and t over a half it stays bounded however deep the trees are. Unless given, the number of trees
follows from the miss that is allowed at the threshold if every node is split down to the last level; tokens are not
taken twice as long as the hashes suffice. The sketches' cut lies 3.5 standard deviations below the threshold.

Defined cases: null and empty texts have an empty set and link with nothing; a text with fewer words than a shingle is
one shingle; equal texts and repeated rows share a class and so a component; a row with a null id can connect others
but names no component unless it is alone (then its component is null); an empty table gives an empty table; columns
other than id and text are not read. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import pieces, rows, stored, texts, together
from voltrail.llm.substrings import Words, mixed


#: Links that one task contracts at a time.
LINKS = 100_000


@dataclass(frozen=True)
class Join:
    shingle: int = 2
    percent: int = 80  # links: 100 * intersection >= percent * union
    trees: int = 0  # 0: as many as miss asks for
    branches: int = 2  # of a class in a node that is split
    depth: int = 3
    miss: float = 1e-4  # of the pairs at the threshold, if every node is split down to the last level
    node: int = 64  # classes that are compared exhaustively
    hashes: int = 256  # two bits of each make the sketch; trees choose from them
    block: int = 4096  # classes of a group whose sketches meet as many others in one piece of work
    cell_bytes: int = 16_000_000  # of sets that meet as many others
    cell_classes: int = 1024  # and these sets' classes

    def __post_init__(self):
        if not self.trees:
            apart = self.missed(1)
            object.__setattr__(self, "trees", 1 if apart <= 0 else math.ceil(math.log(self.miss) / math.log(apart)))

    def missed(self, trees: int) -> float:
        """The probability that a pair at the threshold shares no node of the last level of so many trees."""
        t, below = self.percent / 100, 0.0
        for _ in range(self.depth - 1):
            below = (1 - t + t * below) ** self.branches
        return (1 - t + t * below) ** trees

    @property
    def places(self) -> int:
        """Of a tree: the root's token, and those of each branch below."""
        return sum(self.branches**level for level in range(self.depth))

    @property
    def cut(self) -> float:
        t = self.percent / 100
        match = t + (1 - t) / 4
        return t - 3.5 * (match * (1 - match) / self.hashes) ** 0.5 / 0.75

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(20240229)
        n = self.hashes
        return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)

    def paths(self) -> np.ndarray:
        """The hashes whose tokens each tree takes, from the root, level by level."""
        draw = np.random.default_rng(7)
        trees = max(1, self.hashes // self.places)  # of one permutation
        short = max(0, self.places - self.hashes)  # only in trees with more places than hashes
        dealt = [np.append(draw.permutation(self.hashes), draw.integers(0, self.hashes, short))[: trees * self.places].reshape(trees, self.places) for _ in range(-(-self.trees // trees))]
        return np.concatenate(dealt)[: self.trees]


def shingle_sets(several: list[str], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes. Only A-Z are lower-cased."""
    words = Words(several)
    words.norm = np.where((words.norm >= 65) & (words.norm <= 90), words.norm + np.uint8(32), words.norm)
    h = words.hashes()
    many = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        many = many * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(many)]
    many = mixed(many ^ np.uint64(k))
    bounds = np.append(words.first, len(h))
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            out.append(np.unique(many[a : b - k + 1]))
        elif b > a:  # fewer words than a shingle
            few = np.array([b - a], np.uint64)
            for x in h[a:b]:
                few = few * np.uint64(0xA24BAED4963EE407) + x
            out.append(mixed(few))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minwise(values: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of a set under each of the hash functions."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    a, b = factors
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 512):
        x = (low[start : start + 512, None] ^ b) * a
        x ^= x >> np.uint32(15)
        np.minimum(best, (x * np.uint32(0x2C1B3C6D)).min(axis=0), out=best)
    return best


def two_bits(tokens: np.ndarray) -> bytes:
    t = tokens * np.uint32(0x9E3779B1)
    return np.packbits(np.concatenate([t >> np.uint32(31), t >> np.uint32(30) & np.uint32(1)]).astype(np.uint8)).tobytes()


def signatures(df: DataFrame, join: Join) -> DataFrame:
    """Per row: doc_id, text_hash, n (size of the set), set (its digest), sketch, and the minwise tokens of the trees."""
    one = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = one.withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, paths = join.factors(), join.paths().ravel()
        for batch in pieces(batches, mb=2):
            sets = shingle_sets(texts(batch), join.shingle)
            least = [minwise(s, factors) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array(map(two_bits, least), pa.binary()), pa.array([x[paths].tobytes() for x in least], pa.binary())],
                ["doc_id", "text_hash", "n", "set", "sketch", "paths"],
            )

    return one.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n long, set binary, sketch binary, paths binary")


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch of a with each of b; axes before the last two are gone through side by side."""
    half = a.shape[-1] // 2
    x, y = a[..., :, None, :], b[..., None, :, :]
    differ = (x[..., :half] ^ y[..., :half]) | (x[..., half:] ^ y[..., half:])
    share = 1 - np.bitwise_count(differ.view(np.uint64)).sum(axis=-1, dtype=np.int32) / (half * 8)
    return (share - 0.25) / 0.75


def candidates(sketches: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, join: Join) -> np.ndarray:
    """The estimates of pairs that may be links, -1 for the rest."""
    est = similarity(sketches, others)
    x, y = sizes[..., :, None], other_sizes[..., None, :]
    return np.where((est >= join.cut) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * join.percent), est, -1.0)


#: A class in a node: the node's key, the place of its next branches in the tree, the class, its size, sketch and tokens.
TREE_ROW = "leaf long, at int, node long, n long, sketch binary, path binary"
NAMES = [x.split()[0] for x in TREE_ROW.split(", ")]
#: What a node has found: kind 0, a class of a group (leaf) with its likeliest and its smallest partner; kind 1, a row one level deeper.
STEP = f"kind int, best long, est double, least long, {TREE_ROW}"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of binary values of equal length, a row for each."""
    if not len(column):
        return np.empty((0, 0), kind)
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).view(kind)


def _binary(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.nbytes // max(1, len(data)))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def first_level(classes: DataFrame, join: Join) -> DataFrame:
    """A row per class and tree, with the node it belongs to at the first level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 4000):
            n = batch.num_rows
            path = _matrix(batch.column("paths"), np.uint32).reshape(n * join.trees, join.places) if n else np.empty((0, join.places), np.uint32)
            tree = np.tile(np.arange(join.trees, dtype=np.uint64), n)
            take = pa.array(np.repeat(np.arange(n), join.trees))
            key = mixed((tree << np.uint64(32)) + path[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), np.int32)), *(batch.column(c).take(take) for c in ("node", "n", "sketch")), _binary(path)], NAMES)

    return classes.where("n > 0").select("node", "n", "sketch", "paths").mapInArrow(run, TREE_ROW)


class _Rows:
    """Rows of the tree as arrays."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.leaf, self.at, self.node, self.n, self.sketch, self.path = arrays

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        column = dict(zip(NAMES, (batch.column(c) for c in NAMES)))
        return cls([*(column[c].to_numpy() for c in NAMES[:4]), _matrix(column["sketch"], np.uint8), _matrix(column["path"], np.uint32)])

    def __len__(self) -> int:
        return len(self.leaf)

    def __getitem__(self, which) -> _Rows:
        return _Rows([a[which] for a in self.arrays])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows([np.concatenate(x) for x in zip(self.arrays, other.arrays)]) if len(self) else other


def _deeper(r: _Rows, join: Join) -> pa.RecordBatch:
    """The rows of large nodes, once for each branch."""
    b = join.branches
    at = (np.repeat(r.at.astype(np.int64) * b + 1, b).reshape(-1, b) + np.arange(b)).ravel()
    which = np.repeat(np.arange(len(r)), b)
    token = r.path[which, at].astype(np.uint64)
    key = mixed(r.leaf.view(np.uint64)[which] * np.uint64(0x9FB21C651E98DF25) + (at.astype(np.uint64) << np.uint64(32)) + token)
    d = r[which]
    none = pa.nulls(len(d), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(d), np.int32)), none, pa.nulls(len(d), pa.float64()), none, pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(d.node), pa.array(d.n), _binary(d.sketch), _binary(d.path)],
        ["kind", "best", "est", "least", *NAMES],
    )


def _found(group: np.ndarray, node: np.ndarray, best: np.ndarray, est: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Classes of groups with their partners; an estimate of -1 stands for none."""
    none, lost = est < 0, len(node)
    empty = [pa.nulls(lost, k) for k in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(lost, np.int32)), pa.array(best, mask=none), pa.array(est, mask=none), pa.array(least, mask=none), pa.array(group), empty[0], pa.array(node), empty[1], empty[2], empty[3]],
        ["kind", "best", "est", "least", *NAMES],
    )


_NONE = np.iinfo(np.int64).max


def _compared(r: _Rows, begins: np.ndarray, sizes: np.ndarray, join: Join) -> Iterator[pa.RecordBatch]:
    """Small nodes, exhaustively: the classes that sketches connect are a group."""
    for size in np.unique(sizes[sizes > 1]):
        of = begins[sizes == size]
        step = max(1, 100_000 // int(size) ** 2)
        for start in range(0, len(of), step):
            at = of[start : start + step, None] + np.arange(size)
            node, own = r.node[at], np.arange(size)
            est = candidates(r.sketch[at], r.n[at], r.sketch[at], r.n[at], join)
            est[:, own, own] = -1
            near = est > 0
            has = near.any(axis=2)
            if not has.any():
                continue
            label = np.broadcast_to(own, at.shape)
            while True:
                lower = np.minimum(label, np.where(near, label[:, None, :], size).min(axis=2))
                if (lower == label).all():
                    break
                label = lower
            group = mixed(r.leaf[at].view(np.uint64) + (label.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            best = est.argmax(axis=2)
            least = np.where(near, node[:, None, :], _NONE).min(axis=2)
            yield _found(group[has], node[has], np.take_along_axis(node, best, 1)[has], est.max(axis=2)[has], least[has])


def _led(r: _Rows, leaders: _Rows | None, join: Join) -> tuple[pa.RecordBatch, _Rows]:
    """Classes of a large node of the last level, compared with each other and with its leaders; who is close to none becomes
    a leader, up to a number. All classes are listed, as any may have a link that this comparison leaves out."""
    others = r if leaders is None else leaders + r
    est = candidates(r.sketch, r.n, others.sketch, others.n, join)
    est[r.node[:, None] == others.node] = -1
    best, least = est.argmax(axis=1), np.where(est > 0, others.node, _NONE).min(axis=1)
    found = _found(mixed(r.leaf.view(np.uint64)).view(np.int64), r.node, others.node[best], est.max(axis=1), least)
    if leaders is None:
        return found, r
    far = est[:, : len(leaders)].max(axis=1) < (1 + join.cut) / 2
    return found, (leaders + r[far])[: 8 * join.node]


def node_step(table: DataFrame, join: Join, last: bool) -> DataFrame:
    """Of each node's classes, either those that have partners or the rows one level deeper."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, leaders = None, None, None  # rows of the node that may go on, or its key if it is large
        for batch in chain(batches, [None]):
            r = _Rows.of(batch) if batch is not None else None
            if held is not None:
                r = held if r is None else held + r
            held = None
            if r is None or not len(r):
                continue
            cuts = np.flatnonzero(r.leaf[1:] != r.leaf[:-1]) + 1
            begins = np.append(0, cuts)
            sizes = np.diff(np.append(begins, len(r)))
            big = sizes > join.node
            big[0] |= r.leaf[0] == large
            if batch is not None and not big[-1]:
                held = r[begins[-1] :]
                begins, sizes, big = begins[:-1], sizes[:-1], big[:-1]
            yield from _compared(r, begins[~big], sizes[~big], join)
            if last:
                for begin, size in zip(begins[big], sizes[big]):
                    if r.leaf[begin] != large:
                        large, leaders = r.leaf[begin], None
                    for start in range(begin, begin + size, join.node):
                        found, leaders = _led(r[start : min(start + join.node, begin + size)], leaders, join)
                        yield found
            elif big.any():
                for part in np.array_split(np.flatnonzero(np.repeat(big, sizes)), -(-int(sizes[big].sum()) // 10_000)):
                    yield _deeper(r[part], join)
            large = r.leaf[-1] if held is None else None

    return table.repartition("leaf").sortWithinPartitions("leaf", "node").mapInArrow(run, STEP)


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("part", F.coalesce("part", "node"))


def unsettled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """main and node: the classes of groups (leaf, node) that hold classes of several components. Groups are one if confirmed links have
    made their largest component (main) the same, and not if they merely share classes, so groups don't chain."""
    table = _placed(found.select("leaf", "node"), labels)
    leaves = table.groupBy("leaf", "part").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.count("*").alias("parts"), F.max(F.struct("k", "part"))["part"].alias("main"))
    return table.join(leaves.where("parts > 1"), "leaf").select("main", "node").distinct()


def cells(members: DataFrame, labels: DataFrame, room: int) -> DataFrame:
    """The groups' classes (main, node, weight) dealt to cells, in which each class of a component other than the main one meets each class.

    A group has a cell per block of the former and block of all, so a class is in as many cells as needed, and a block's weight is about
    the room at most.
    """
    table = _placed(members, labels).withColumn("own", F.col("part") != F.col("main"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(room)))
    weight = F.sum(F.when(F.col("own"), F.col("weight")))
    groups = table.groupBy("main").agg(blocks(weight).alias("downs"), blocks(F.sum("weight")).alias("acrosses"), weight.alias("some")).where("some IS NOT NULL").drop("some")
    down, aside = F.pmod(F.xxhash64("node", F.lit(1)), "downs"), F.pmod(F.xxhash64("node", F.lit(2)), "acrosses")
    cell = lambda i, j, own, other: F.struct(i.alias("i"), j.alias("j"), own.alias("own"), other.alias("other"))
    own = F.col("own")
    as_other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("downs") - 1), lambda i: cell(i, aside, own & (i == down), F.lit(True)))
    rest = F.filter(F.sequence(F.lit(0).cast("long"), F.col("acrosses") - 1), lambda j: own & (j != aside))
    as_own = F.transform(rest, lambda j: cell(down, j, F.lit(True), F.lit(False)))
    dealt = table.join(groups, "main").select("main", "node", "part", F.explode(F.concat(as_other, as_own)).alias("c"))
    return dealt.select(F.xxhash64("main", "c.i", "c.j").alias("cell"), "main", "node", "part", "c.own", "c.other")


def _near(group: dict[str, list], join: Join, chunk: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a cell, piece by piece: the pairs of classes of different components whose sketches allow a link, as places, with their estimates."""
    sketches = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group["cell"]), -1)
    sizes, parts = (np.array(group[c], np.int64) for c in ("n", "part"))
    own, other = (np.flatnonzero(group[c]) for c in ("own", "other"))
    for start in range(0, len(own), chunk):
        x = own[start : start + chunk]
        for at in range(0, len(other), 2048):
            y = other[at : at + 2048]
            est = candidates(sketches[x], sizes[x], sketches[y], sizes[y], join)
            i, j = np.nonzero((est > 0) & (parts[x][:, None] != parts[y][None, :]))
            if len(i):
                yield x[i], y[j], est[i, j]


def likely(members: DataFrame, labels: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Of the groups' classes those that sketches may link with one of another component; no set is read for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cell"):
            some = np.zeros(len(group["cell"]), bool)
            for x, y, _ in _near(group, join):
                some[x] = some[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.array(group[c], np.int64)[some]) for c in ("main", "node")], ["main", "node"])

    dealt = cells(members.withColumn("weight", F.lit(1)), labels, join.block).join(classes.select("node", "n", "sketch"), "node")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "main long, node long").distinct()


def across(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that connect classes of different components of a group, as far as sketches allow them.

    Only classes with such a pair meet with their sets, in cells bounded by the sets' bytes and the classes' number. A cell takes its pairs piece
    by piece, the likeliest of a piece first, and compares the full sets of those that its links so far leave apart; so a component costs it no more links than there are others, and
    no pair leaves the cell that isn't a link.
    """

    def links(group: dict[str, list]) -> Iterator[tuple[int, int]]:
        nodes, parts = (np.array(group[c], np.int64) for c in ("node", "part"))
        root = {p: p for p in set(parts.tolist())}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        for x, y, est in _near(group, join):
            now = np.array([top(p) for p in parts.tolist()], np.int64)
            apart = now[x] != now[y]
            x, y, est = x[apart], y[apart], est[apart]
            order = np.lexsort((nodes[y], nodes[x], -est))
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                u, v = top(int(parts[i])), top(int(parts[j]))
                if u != v and linked(group["shingles"][i], group["shingles"][j], join):
                    root[max(u, v)] = min(u, v)
                    yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cell"):
            made = list(links(group))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    some = stored(likely(members, labels, classes, join), "likely").join(classes.select("node", "n", "sketch"), "node")
    dealt = cells(some.select("main", "node", F.greatest(F.col("n") * 6, F.lit(join.cell_bytes // join.cell_classes)).alias("weight")), labels, join.cell_bytes)
    known = sets.join(classes.select("node", "n", "sketch"), "node").join(some.select("node").distinct(), "node", "left_semi")
    return dealt.join(known, "node").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def linked(x: bytes, y: bytes, join: Join) -> bool:
    """Whether two classes' full sets (sorted hashes of 48 bits) are similar enough."""
    u, v = (np.zeros((len(s) // 6, 8), np.uint8) for s in (x, y))
    u[:, 2:], v[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6), np.frombuffer(y, np.uint8).reshape(-1, 6)
    u, v = u.view(np.uint64).ravel(), v.view(np.uint64).ravel()
    if len(u) > len(v):
        u, v = v, u
    common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 100 * common >= join.percent * (len(u) + len(v) - common)


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Runs of rows of one key, as lists by column."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = batch.to_pydict()
        keys = np.array(columns[key])
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[key][0] != keys[a]:
                yield held
                held = {}
            for c, v in columns.items():
                held.setdefault(c, []).extend(v[a:b])
    if held:
        yield held


def full_sets(df: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The shingles (48 bits of each hash) of the classes in nodes (node, doc_id, text_hash)."""
    one = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    keys = nodes.select("node", F.col("doc_id").alias("node_doc"), F.col("text_hash").alias("node_hash"))
    wanted = one.join(keys, F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("text_hash") == F.col("node_hash"))).select("node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in pieces(batches, mb=2):
            node = batch.column("node").to_numpy()
            new = np.append(node[0] != before, node[1:] != node[:-1])  # rows repeated in the table come side by side
            before = node[-1]
            batch = batch.filter(pa.array(new))
            sets = [s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in shingle_sets(texts(batch), join.shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return wanted.mapInArrow(run, "node long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that are links on full sets. A pair without its sets is an error."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            keep = []
            if batch.column("x").null_count or batch.column("y").null_count:
                raise ValueError("a pair without its full sets")
            for x, y in zip(batch.column("x"), batch.column("y")):
                keep.append(linked(x.as_py(), y.as_py(), join))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """The links (a, b) of each task as stars (u, v): from each node to the smallest one that it is connected with there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[up]
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            stars = [(x, v) for x in parent if (v := root(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in stars], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, joined to blocks of about LINKS rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LINKS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def components(links: DataFrame, n: int) -> DataFrame:
    """node and part (the smallest node that links reach) of n links (a, b).

    Tasks contract blocks of links to stars. If there are several blocks, alternating stars follow until nothing changes.
    """
    blocks = -(-n // LINKS) or 1
    edges = stored(contracted(links.select("a", "b").repartition(blocks)), "stars")
    before = None
    while blocks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        edges = stored(small.where("v > m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v")), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return found.unionByName(found.select(F.col("part").alias("node"), "part").distinct())


def kept_documents(df: DataFrame, join: Join) -> DataFrame:
    """The rows of df whose id is their component's. Columns other than doc_id and text may have any names."""
    kept = near_duplicates(df, join).where("kept").select("doc_id", "text_hash").distinct()
    rest = [c for c in df.columns if c not in ("doc_id", "text")]
    one = df.select("doc_id", "text", together(rest))
    one = one.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = one["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (one["text_hash"] == kept["text_hash"])
    left = one.join(kept, same, "left_semi")
    return left.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in df.columns))


def near_duplicates(df: DataFrame, join: Join = Join()) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept (whether
    the id is the component's)."""
    docs = stored(signatures(df, join), "signatures")
    # copies meet here once per task; their rows are not gathered
    row = F.min(F.struct("doc_id", "text_hash", "n", "sketch", "paths"))
    classes = docs.groupBy("set").agg(row.alias("r"), F.min("doc_id").alias("first_id"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "set", "first_id", "r.*"), "classes")

    level = first_level(classes, join)
    steps = []
    for depth in range(1, join.depth + 1):
        step = stored(node_step(level, join, depth == join.depth), "nodes")
        steps.append(step.where("kind = 0").select("leaf", "node", "best", "est", "least"))
        level = step.where("kind = 1").select(*NAMES)
        if depth < join.depth and level.isEmpty():
            break
    found = reduce(DataFrame.unionByName, steps)

    chosen = found.groupBy("node").agg(F.max(F.struct("est", "best"))["best"].alias("best"), F.min("least").alias("least"))
    chosen = stored(chosen, "chosen")
    involved = chosen.join(classes.select("node", "doc_id", "text_hash"), "node")
    sets = stored(full_sets(df, involved, join), "sets")

    other = chosen.select("node", F.explode(F.array_distinct(F.array("best", "least"))).alias("other")).where("other IS NOT NULL")
    tried = stored(other.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "tried")
    links = stored(confirm(tried, sets, join), "links")
    labels = components(links, links.count())
    # what these pairs have not shown: links across components in groups and large nodes
    members = stored(unsettled(found, labels), "members")
    new = stored(across(members, labels, classes, sets, join), "links")
    if not new.isEmpty():
        links = links.unionByName(new)
        labels = components(links, links.count())

    named = classes.where("n > 0").select("set", "node", "first_id").join(labels, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = named.groupBy("part").agg(F.min("first_id").alias("least"))
    out = docs.select("doc_id", "text_hash", "n", "set").join(named.join(least, "part").select("set", "least"), "set", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
