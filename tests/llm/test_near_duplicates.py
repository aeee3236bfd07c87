import math
import random
from collections import Counter, defaultdict

import numpy as np

from quire.llm import embedding, minhash
from quire.llm.components import components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def grouped(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets[doc] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, grouped(sets, links)


def near_copies(rng, count):
    words = [f"w{rng.randrange(500)}" for _ in range(200)]
    for _ in range(count):
        copy = list(words)
        for k in rng.sample(range(200), 6):
            copy[k] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_minhash_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DOCS).collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(near_copies(rng, 60))]
    rows += [(20_000 + k, "a b") for k in range(5)] + [(30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one"), (30_004, "ONE"), (30_005, "é É")]
    for width, percent in ((2, 80), (5, 80)):
        sets, groups = brute(rows, width, percent)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r["doc_id"]: r for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}
        assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in found.items()} == {d: (len(sets[d]), groups[d], groups[d] == d) for d in sets}


def test_minhash_edge_cases(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 1), (7, "a b c", 1), (7, "q r s", 1), (9, "q r s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, width=2).collect())
    assert found == {(None, None, True): 2, (7, 7, True): 2, (9, 7, False): 1}
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in components(df).collect()} == grouped(nodes, [x for x in links if x[0] != x[1]])


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = []
    for k in range(400):
        v = base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [math.nan] * 16, 1), (504, rows[0][1], None), (505, [1e300] * 2, 1), (506, [2e300] * 2, 1), (507, [], 1)]
    links = defaultdict(set)
    for i, a, x in rows:
        for j, b, y in rows:
            if i < j and x is not None and x == y and a and b and len(a) == len(b) and None not in a and None not in b and any(a) and any(b) and not any(map(math.isnan, a + b)):
                p, q = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if p @ q / math.sqrt(p @ p) / math.sqrt(q @ q) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in embedding.near_vectors(df).collect()}
    total = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * total > 200
    assert all(r["n_links"] <= len(links[i]) for i, r in found.items())
    groups = grouped(found, [(i, j) for i in links for j in links[i]])
    assert sum(r["component_id"] == groups[i] for i, r in found.items()) >= 0.99 * len(rows)
    assert embedding.near_vectors(df.limit(0)).collect() == []


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 7)
    rows = [(k, [1.0, k * 1e-6], 0) for k in range(50)] + [(100 + k, [1.0, 0.0], 0) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r["n_links"], r["component_id"]) for r in embedding.near_vectors(df).collect()} == {(54, 0)}


def test_more_vectors_more_projections():
    shapes = [embedding.shape(n, 0.98) for n in (10, 10**5, 10**9)]
    assert shapes == sorted(shapes)
    for per_table, tables in shapes:
        assert (1 - embedding.collision(0.2) ** per_table) ** tables <= embedding.MISS * 1.001


def test_bundles_of_many_blocks(spark, monkeypatch):
    """Members too far apart for one star, in blocks of four sets."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        copy = list(base)
        for at in range(3 * (k % 10), 3 * (k % 10) + 9):
            copy[at] = f"x{k % 20}-{at}"
        rng.random() < 0.3 and copy.append("end")
        rows.append((k, " ".join(copy)))
    sets, groups = brute(rows, 2, 80)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    monkeypatch.setattr(minhash, "STRIPE", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, width=2).collect()} == groups
    assert (minhash._overlaps([np.array([1, 2, 3])], [np.array([2, 3, 4]), np.array([], np.int64)]) == [[2, 0]]).all()


def test_vectors_of_floats_and_clashing_columns(spark):
    """Columns named as the operator's own do not disturb it, and narrow vectors give the links of wide ones."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 8)).astype(np.float32)
    rows = [(k, [float(np.float32(x)) for x in base[k % 6] + np.float32(0.04) * rng.standard_normal(8).astype(np.float32)], k % 2, "x", k, 1) for k in range(120)]
    names = "vec_id long, embedding array<{}>, label int, buckets string, c long, t int"
    found = [sorted(map(tuple, embedding.near_vectors(spark.createDataFrame(rows, names.format(kind))).collect())) for kind in ("float", "double")]
    assert found[0] == found[1] and sum(r[1] for r in found[0]) > 100
