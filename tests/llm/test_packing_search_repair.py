"""Packing, ranked search and conversation repair against plain versions, with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltrail.llm import lexical, packing, turn_repair

JSON = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


# packing


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def filled(counts, how):
    """How full each sequence of the plan is, and the plan."""
    plan = packing.planned(counts, how)
    lengths = np.repeat(np.arange(how.capacity, -1, -1), counts[::-1])
    seq = plan.of(np.arange(len(lengths)))
    fill = np.bincount(seq, lengths, plan.sequences)
    assert len(fill) == plan.sequences and fill.max() <= how.capacity and fill.min() > 0
    return fill, plan


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plan_is_near_the_optimum():
    r = random.Random(4)
    more = 0
    for _ in range(60):
        capacity = r.choice([10, 24, 64])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        how = packing.Packing(capacity=capacity, groups=r.choice([2, 4, 128]), small=r.choice([4, 8]))
        _, plan = filled(counts_of(lengths, capacity), how)
        least = fewest(lengths, capacity)
        assert plan.sequences <= least + (1 if how.groups == 128 else 1)
        more += plan.sequences > least
    assert more <= 12


def test_plan_of_many_pieces():
    """Against the bound of their sum, and never more than first-fit by falling length."""
    r = np.random.default_rng(1)
    for make in (lambda: r.integers(1, 2049, 4000), lambda: r.lognormal(6.4, 0.9, 6000).astype(int).clip(1, 2048), lambda: r.choice([683, 1025, 700, 300], 3000)):
        lengths = make()
        _, plan = filled(counts_of(lengths, 2048), packing.Packing())
        bins = []
        for x in sorted(lengths.tolist(), reverse=True):
            for i, b in enumerate(bins):
                if b + x <= 2048:
                    bins[i] += x
                    break
            else:
                bins.append(x)
        assert plan.sequences <= len(bins)


def test_configuration_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.sort(r.choice(np.arange(3, 20), 4, replace=False))[::-1]
        prices, most = r.random(4), r.integers(1, 4, 4)
        value, chosen = packing.best_configuration(prices, sizes, most, 20)
        ways = [w for w in itertools.product(*(range(m + 1) for m in most)) if np.dot(w, sizes) <= 20]
        assert value == pytest.approx(max(float(np.dot(w, prices)) for w in ways)) and float(chosen @ prices) == pytest.approx(value)
        assert chosen @ sizes <= 20 and (chosen <= most).all()


def test_plan_without_pieces():
    assert packing.planned(np.zeros(2049, np.int64), packing.Packing()).sequences == 0


def packing_rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéñ漢 .,\n") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(r.choice([1, 3, 30, 200, 900, 3000]))) for _ in range(60)]
    texts += ["", None, "a<|endoftext|>b", "࢏ new letters ꟝", "x" * 5000, texts[3], texts[3]]
    return [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", 2), (3, texts[3], "again", 3)]


def test_packed_documents(spark, library):
    """Ids as the library gives them, cut as asked, placed without gaps, in few sequences."""
    rows = packing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, length int").repartition(5)
    how = packing.Packing(capacity=256)
    got = packing.packed(df, JSON, public_tokenizers.PATTERN, how).collect()
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        many = -(-len(ids) // 256)
        cuts = [0, *(len(ids) - 256 * (many - 1 - k) for k in range(many))]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 256 and len(held) <= 1.03 * math.ceil(total / 256) + 2


def test_packing_beyond_the_sent_table(spark, monkeypatch):
    df = spark.createDataFrame(packing_rows(), "doc_id long, text string, a string, b int").repartition(3)
    make = lambda: sorted(map(tuple, packing.packed(df, JSON, public_tokenizers.PATTERN, packing.Packing(capacity=128)).collect()), key=str)
    want = make()
    monkeypatch.setattr(packing, "SENT_ROWS", 0)
    assert make() == want


def test_sequences_hold_their_tokens(spark, library, tmp_path):
    df = spark.createDataFrame([(i, f"document number {i} " * (i + 1)) for i in range(12)], "doc_id long, text string")
    packing.pack(df, str(tmp_path / "s"), JSON, public_tokenizers.PATTERN, packing.Packing(capacity=64, end_id=50256))
    whole = {}
    for r in packing.unpacked(spark.read.parquet(str(tmp_path / "s"))).collect():
        assert r["n_tokens"] == len(r["tokens"]) == sum(p["length"] for p in r["pieces"])
        for p in r["pieces"]:
            whole.setdefault(p["doc_id"], {})[p["start"]] = r["tokens"][p["offset"] : p["offset"] + p["length"]]
    for i, parts in whole.items():
        ids = [t for _, part in sorted(parts.items()) for t in part]
        assert ids == library.encode(f"document number {i} " * (i + 1), add_special_tokens=False).ids + [50256]
    assert len(whole) == 12


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(none, JSON, public_tokenizers.PATTERN).collect() == []


def test_encoder_equals_the_library(library):
    definition = open(JSON, encoding="utf-8").read()
    encoder = packing.TextEncoder(definition, public_tokenizers.PATTERN)
    assert encoder.by_segment
    r = random.Random(9)
    letters = "abcXYZ  \n\t.,'s<|endoftext|>é漢字　\xa0\x85٣１Ⅷ²½ǅʰ́🙂0123456789_-#'ll࢏՘"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "<|endoftext|>"]
    ids, sizes = encoder.encode_flat(odd)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    whole = packing.TextEncoder(definition.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'), public_tokenizers.PATTERN)
    assert not whole.by_segment and whole.encode_flat(["ab", "", "a b"])[1].tolist()[1] == 0


# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, Counter(terms(t))) for d, t in docs]
    count, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * count // length if length else 0
            s = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if lost else d, -s) for r, (s, lost, d) in enumerate(sorted(scores)[:k])]
    return out


def search_rows(n=400, seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)] + ["É", "é", "漢字", "Don't", "x_y", "THE", "the", "42"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: r.choice([" ", "-", "\n"]).join(r.choices(words, weights, k=k))
    docs = [(i, text(r.randint(1, 60))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "...!"), (None, text(20)), (7, "w80 " * 3000)]
    docs += [docs[5], docs[5], (n + 9, docs[5][1])]
    items = [(i, text(r.randint(1, 25))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, " ".join(words * 2)), (34, "w85 w80 w80"), (0, "w3 w4"), (None, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("step, block", [(512, 32_768), (3, 40)])
def test_ranked_search(spark, monkeypatch, step, block):
    """Also with small blocks and few documents scored at a time, so that groups are left out."""
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = search_rows()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string").repartition(4)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.search(df, asked, 6).collect()), key=str)
    assert got == sorted(plain_search(docs, items, 6), key=str)


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs, items = search_rows(120, 5)
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEMS_MB", 0.0004)
    assert sorted(map(tuple, lexical.search(df, asked).collect()), key=str) == sorted(plain_search(docs, items, 10), key=str)


def test_groups_are_left_out():
    """A block scores fewer documents than hold a term, and still finds the best."""
    r = np.random.default_rng(0)
    n = 5000
    rare, common = np.sort(r.choice(n, 30, replace=False)), np.arange(n)
    held = np.ones(n, np.int64)
    held[rare] += 1
    term = np.concatenate([[0, 1] if i in set(rare.tolist()) else [0] for i in range(n)])
    block = lexical.Block(common, np.zeros(n, bool), r.integers(5, 50, n), held, term, np.ones(len(term), np.int64), np.array([3, 4000]), n, 25 * n)
    best = lexical.Best(10)
    assert block.search([(0, 1), (1, 1)], best) < n / 5 and set(best.doc.tolist()) <= set(rare.tolist())


def test_search_nothing(spark):
    docs, items = search_rows(5)
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical.search(none, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert lexical.search(some, spark.createDataFrame([], "item_id long, text string")).collect() == []


# conversation repair


def plain_repair(rows):
    """Cheapest edits by trying all audits in order of cost and letters, for short conversations (role, text)."""
    seen, kinds = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0d]", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best is not None and (cost, audit) > best[:2] and cost >= best[0] or len(audit) > len(rows) + 3:
            return
        initials = "".join(r[:1] or "?" for r, _ in out)  # an empty role fits nowhere
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, out)) if best is not None else (cost, audit, out)
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            more = 3 if kinds[i] == "truncated" else 0
            go(i + 1, cost + 4, audit + "D", out)
            if kinds[i] not in ("blank", "duplicate"):
                go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return kinds, best


def test_repair_by_brute_force(spark):
    r = random.Random(11)
    texts = ["Yes.", "No!", "cut off", " \t", "", "Ok?", "Ok? \n", " "]
    roles = ["user", "assistant", "system", "tool", "", "unknown", "student"]
    convs = {c: [(t, r.choice(roles[:3] if c % 3 else roles), r.choice(texts)) for t in range(r.randint(1, 5))] for c in range(60)}
    df = spark.createDataFrame([(c, t, role, text, "clash") for c, rows in convs.items() for t, role, text in rows], "conv_id long, turn long, role string, text string, cost string").repartition(5)
    got = {x["conv_id"]: x for x in turn_repair.repair(df).collect()}
    assert got.keys() == convs.keys()
    for c, rows in convs.items():
        kinds, (cost, audit, out) = plain_repair([x[1:] for x in rows])
        g, initials = got[c], [x[1][:1] for x in rows]
        assert (g["cost"], g["audit"]) == (cost, audit), (c, rows)
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert (g["blank"], g["duplicate"], g["truncated"]) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert g["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) and g["gaps"] == 0


def awkward_conversations():
    rows = [(1, 0, "user", "Hi."), (1, 5, "assistant", "Yes."), (1, None, "user", "first."), (2, None, None, None), (None, 1, "user", "no id."), (None, 2, "assistant", "Fine."), (3, 4, "user", "x" * 100_000 + "."), (3, 4, "user", "x" * 100_000 + "."), (3, 4, "assistant", "Same turn.")]
    return rows + [(9, t, ("user", "assistant")[t % 2], f"turn {t}" + ".!? "[t % 4]) for t in range(6000)] + [(10, t, "assistant", "Same.") for t in range(3000)]


def test_repair_of_awkward_rows_as_the_sql(spark):
    """Nulls, repeated rows, equal turns, long texts, and conversations of several pieces, after damage."""
    import duckdb

    df = spark.createDataFrame(awkward_conversations(), "conv_id long, turn long, role string, text string").repartition(6)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(turn_repair.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in turn_repair.repaired(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pieces_and_rules_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([r for r in awkward_conversations() if r[0] in (9, 10)], "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "cost", "audit", "repaired_sha256"]
    want = turn_repair.repaired(df).select(*columns).orderBy("conv_id").collect()
    monkeypatch.setattr(turn_repair, "PIECE", 7)
    assert turn_repair.repaired(df).select(*columns).orderBy("conv_id").collect() == want
    monkeypatch.setattr(turn_repair, "learnt", lambda shapes: [])
    assert turn_repair.repaired(df).select(*columns).orderBy("conv_id").collect() == want


def test_grammar_of_pairs(spark):
    """The most frequent pairs become rules, as long as one occurs twice; runs of one symbol are counted without overlaps."""
    shapes = spark.createDataFrame([(bytearray([3, 5, 3, 5, 3, 5]), 4), (bytearray([1, 1, 1]), 1)], "symbols binary, n long")
    rules = turn_repair.learnt(shapes, a_round=1)
    assert rules[0] == (3, 5) and rules[1] == (9, 9) and (1, 1) not in rules
    codes, ends = turn_repair.compressed([bytes([3, 5, 3, 5, 3, 5]), bytes([1, 1, 1])], rules)
    assert len(codes) < 11 and len(ends) == 2
    g = turn_repair.Grammar(rules)
    plain = turn_repair.Grammar([])
    for piece in (bytes([3, 5, 3, 5]), bytes([0, 2, 4, 7, 8] * 3), bytes([1, 1, 1, 1])):
        assert g.transfers([piece]) == plain.transfers([piece])


def test_ropes():
    r = random.Random(2)
    for _ in range(300):
        texts = ["".join(r.choice("DIK") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 8))]

        def rope(parts):
            if len(parts) == 1:
                return turn_repair.Rope(parts[0])
            cut = r.randint(1, len(parts) - 1)
            return rope(parts[:cut]) + rope(parts[cut:])

        other = [*texts[:-1], "".join(r.choice("DIK") for _ in range(r.randint(0, 3)))]
        a, b = rope(texts), rope(other)
        assert str(a) == "".join(texts) and (a < b) == ("".join(texts) < "".join(other)) and (b < a) == ("".join(other) < "".join(texts))


def test_repair_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repaired(none).collect() == []
    gone = spark.createDataFrame([(c, t, "user", "Hm.") for c in range(60) for t in (0,)], "conv_id long, turn long, role string, text string")
    dropped = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = {x["conv_id"]: x for x in turn_repair.repaired(gone).collect()}
    assert dropped and len(got) == 60
    for c in dropped:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    from voltrail.llm import queries

    for name in ("op12_presence_masks", "op13_grammar_repair"):
        want = con.execute(queries.ORACLES[name]).fetchall()
        columns = [d[0] for d in con.description]
        got = queries.QUERIES[name](spark, SF).select(*(F.col(c) for c in columns)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
