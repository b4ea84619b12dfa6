"""Hard negatives, conversation tries and repeated passages against brute force, and at the edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewise.llm import negatives, substring, trie

# --- hard negatives ----------------------------------------------------------


def mined(rows, k=5, m=10):
    """Brute force over (vec_id, label, vector)."""
    ok = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, str(r[2]))):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if i not in ok or (label, q) < ok[i]:
            ok[i] = (label, q)
    out = []
    for a, (label, q) in ok.items():
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, other) for i, (other, w) in ok.items() if i != a)
        for p, i in [(-p, i) for p, i, other in s if other == label][:k]:
            foes = [(-n, j) for n, j, other in s if other != label and 30 * p <= -100 * n <= 90 * p][:m]
            out += [(a, i, r, j, p, n) for r, (n, j) in enumerate(foes, 1)]
    return sorted(out)


def vectors(n, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8))
    rows = []
    for i in range(n):
        v = centres[i % clusters] + rng.normal(size=8) * 0.3
        rows.append((i, int(rng.integers(4)), [float(x) for x in v]))
    return rows


SCHEMA = "vec_id long, label long, embedding array<double>"


@pytest.mark.parametrize("sizes", [{}, {"sample": 40, "group": 2, "part": 60}])
def test_negatives_are_exact(spark, sizes):
    rows = vectors(700, 3) + [(1000 + i, i % 3, [0.5] * 8) for i in range(240)]  # a third of all rows are one vector
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 100 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_negatives_at_the_edges(spark):
    rows = vectors(60, 4) + [(100, 1, None), (200, None, [1.0] * 8), (300, 1, [float("nan")] * 8), (400, 1, [1.0, None] + [1.0] * 6), (None, 1, [1.0] * 8), (500, 1, [1.0, 2.0]), (600, 2, []), (5, 1, [9.0] * 8), (5, 1, [9.0] * 8), (700, 1, [1e300] * 8), (800, 1, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", anchor_id string")
    usable = [r for r in rows if r[0] != 700]
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == mined(usable)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_scores_stay_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i), float(2**21 - 3 * i), 1.0 / (i + 1)]) for i in range(30)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_bounds_keep_far_cells_from_groups(spark):
    """Clusters that lie apart: a group receives its own cluster's rows and few others."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(x) for x in np.eye(8)[i % 8] * 40 + rng.normal(size=8) * 0.01]) for i in range(1600)]
    df = spark.createDataFrame(rows, SCHEMA)
    sent = []
    whole = negatives.joined

    def joined(candidates, *a):
        sent.append(candidates.agg(F.sum(F.length("ids") / 8)).first()[0])
        return whole(candidates, *a)

    negatives.joined = joined
    try:
        got = negatives.mine(df, F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == mined(rows)
    finally:
        negatives.joined = whole
    assert sent[0] < 1600 * 2


# --- conversation tries ------------------------------------------------------


def tried(rebuilt):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string"


def talk(n, seed):
    """Conversations of which a third is one and the same, a third share a long beginning, and turns are few."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = c % 3
        turns = [("user", "same"), ("assistant", "answer")] if kind == 0 else [("user", f"long {i}") for i in range(12)] if kind == 1 else []
        turns = turns + ([] if kind == 0 else [(rng.choice(["user", "assistant"]), rng.choice(["да", "no", ""])) for _ in range(rng.randint(1, 5))])
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def as_rows(df):
    return sorted((*[r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"]], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("limit", [trie.LIMIT, 20])
def test_trie(spark, limit):
    rows = talk(240, 2)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    assert as_rows(trie.nodes(trie.branched(trie.turns(df)), limit)) == tried(rebuilt([r[:4] for r in rows]))


@pytest.mark.parametrize("limit", [trie.LIMIT, 3])
def test_trie_of_whole_conversations(spark, limit):
    """Without rebuilding: prefixes of one another, a chain with an end within it, copies."""
    rows = [(c, t, "u", f"t{t}", None) for c in range(9) for t in range(1 + c % 7)] + [(20 + c, t, "u", "a" if t < 3 else f"{c}", None) for c in range(6) for t in range(5)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    own = defaultdict(list)
    for c, _, r, x, _ in rows:
        own[c].append((r, x))
    assert as_rows(trie.nodes(trie.turns(df), limit)) == tried(own)


def test_trie_at_the_edges(spark):
    rows = [(1, None, None, None, "x"), (1, 1, "user", "b", None), (1, 1, "user", "a", None), (1, 1, "user", "a", None), (2, 5, "user", "word " * 50_000, None), (None, 1, "user", "lost", None), (10, 0, "user", "", None), (11, 0, None, "é", None), (2**60, 3, "x", None, None)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert as_rows(trie.nodes(trie.branched(trie.turns(df)))) == tried(rebuilt([r[:4] for r in rows]))
    assert trie.nodes(trie.branched(trie.turns(df.limit(0)))).count() == 0
    alone = [(c, 0, "u", "t", None) for c in range(2, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]  # the begun ones are absent: turnless
    got = as_rows(trie.nodes(trie.branched(trie.turns(spark.createDataFrame(alone, CONVERSATIONS)))))
    assert got == tried(rebuilt([r[:4] for r in alone])) and len(got) == 1 and got[0][5] == 1


# --- repeated passages -------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stripped(rows, window):
    """Brute force over (doc_id, text); rows that share an id don't see one another, but one text of one id is one document."""
    low = -(2**63)
    first = {}
    docs = {(low if d is None else d, t or "") for d, t in rows}
    words = {k: WORD.findall(k[1]) for k in docs}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, k[0]), k[0])
    out = []
    for d, t in rows:
        k = (low if d is None else d, t or "")
        w, seen, gone = words[k], set(), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if first[key] < k[0] or key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, t, len(w), len(gone), kept))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "слово", "a b", "x" * 300, "…"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 60, 150]))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) :]
        if i % 7 == 0:
            w += w[:25]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # a third are copies
    rows += [(600, " ".join(["again"] * 90)), (601, " ".join(["again"] * 30)), (7, "  "), (602, None), (None, rows[3][1]), (None, rows[6][1] + " tail"), (3, rows[9][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats_go(spark, monkeypatch, small):
    if small:  # many parts, blocks and slices
        for name, value in (("PART_CHARS", 3_000), ("SLICE", 500), ("BLOCK_BITS", 10)):
            monkeypatch.setattr(substring, name, value)
    rows = corpus(5)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_words string, `__kept` long").repartition(5)
    want = stripped(rows, 20)
    got = substring.digest(df)
    key = lambda r: tuple((x is None, x or 0) for x in r[:3]) + tuple(r[3:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(d, n, k, hashlib.sha256(kept.encode()).hexdigest()) for d, _, n, k, kept in want], key=key)
    kept = substring.without_repeats(df.drop("__kept"))
    assert kept.columns == ["doc_id", "text", "n_words", "n_removed"]
    text = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2], r[3])
    assert sorted(map(tuple, kept.collect()), key=text) == sorted([(d, None if t is None else kept, n, k) for d, t, n, k, kept in want], key=text)


def test_repeats_at_the_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:3] for r in substring.digest(df).collect()] == [(0, 0)] * 2
    assert substring.digest(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 50_000), (2, "a b " * 12)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in substring.digest(long).collect()) == [(1, 50_000, 49_999), (2, 24, 22)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("parts_")]


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    h[100:200] = h[:100]
    for layer in range(substring.DEPTH):
        cells = substring.mixed(h, layer) >> np.uint64(64 - 14)
        _, inverse, n = np.unique(cells, return_inverse=True, return_counts=True)
        assert (n[inverse][:200] >= 2).all()


def test_packing_round_trips():
    rng = np.random.default_rng(3)
    for kind in (np.uint64, np.uint32, np.int64):
        a = np.sort(rng.integers(0, 2**31, 1000).astype(kind))
        assert (substring.risen(substring.rising(a), kind) == a).all()
        assert (substring.unpacked(substring.packed(a), kind) == a).all()
    assert len(substring.unpacked(substring.packed(np.zeros(0, np.uint64)), np.uint64)) == 0


def test_windows_are_those_of_the_words():
    texts = ["a b c d", "", "é  ü\tx\n y z", "one"]
    seen = {}
    for number, data, start, end, text, whole, h1, h2 in substring.windows(pa.chunked_array([pa.array(texts[:2]), pa.array(texts[2:])]), 3, True):
        words = [data[s:e].tobytes().decode() for s, e in zip(start, end, strict=True)]
        for i, a, b in zip(whole.tolist(), h1.tolist(), h2.tolist(), strict=True):
            seen[(number + int(text[i]), tuple(words[i : i + 3]))] = (a, b)
    assert set(seen) == {(0, ("a", "b", "c")), (0, ("b", "c", "d")), (2, ("é", "ü", "x")), (2, ("ü", "x", "y")), (2, ("x", "y", "z"))}
    assert len(set(seen.values())) == 5
