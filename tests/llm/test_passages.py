import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import decontaminate, suffixes

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def brute_windows(docs, items, width=13):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, other in items:
            v = words(other)
            n = min(width, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        names.add(str(item))
        ids = sorted(names)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_windows_like_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["a", "b", "C", "É", "é", "x1", "naïve", "中"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    items = [(k, "-".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 13, 14, 20])))) for k in range(12)]
    items += [(12, None), (13, "!!"), (14, items[3][1].upper().replace("É", "É"))]
    docs += [(100 + k, f"lead {items[k][1]} {items[k][1]} tail") for k in range(12)] + [(200, None), (201, "?"), (None, items[4][1]), (100, "again")]
    wanted = brute_windows(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):  # also with every join shuffled
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        found = decontaminate.digests(decontaminate.find(d, b))
        assert sorted(map(tuple, found.collect()), key=str) == wanted
    assert decontaminate.find(d.limit(0), b).collect() == []
    assert {r["n_hit"] for r in decontaminate.find(d, b.limit(0)).collect()} == {0}


def brute_bytes(rows, length=100):
    seen, out = {}, {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], (doc, s)) != (doc, s):
                gone[s : s + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[doc] = (bytes(np.frombuffer(raw, np.uint8)[~gone]), len(raw), int(gone.sum()), runs)
    return out


def test_substrings_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_ENTRIES", 500)
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").orderBy("doc_id").collect()]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    for k in range(60):  # a passage in many documents, each with its own surroundings
        own = "".join(rng.choice("abcdefgh ") for _ in range(120))
        rows.append((1000 + k, own[:60] + passage[k % 40 : 160 - k % 7] + own[60:]))
    rows += [(2000, "a" * 500), (2001, "b" + "a" * 300), (2002, "ab" * 150), (2003, None), (2004, ""), (2005, "x" * 99), (2006, "é" * 90), (2007, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_substrings(df).collect()}
    assert found == brute_bytes(rows)
    assert suffixes.dedup_substrings(df.limit(0)).collect() == []


def test_substrings_of_null_and_repeated_rows(spark):
    text = "0123456789" * 9 + "the end of it all"
    df = spark.createDataFrame([(None, text, 1), (5, text, 1), (5, text, 1), (6, text + "!", 1)], "doc_id long, text string, raw int")
    found = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffixes.dedup_substrings(df).collect())
    assert found == [("5", len(text)), ("5", len(text)), ("6", len(text)), ("None", 0)]


def test_copies_are_sorted_once(spark, monkeypatch):
    """Of many copies of a text, the suffix array is given about one."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text, sizes, run_pass = word(4000), [], suffixes._run_pass

    def counted(table, *more):
        sizes.append(sum(len(r["raw"]) for r in table.select("raw").collect()))
        return run_pass(table, *more)

    monkeypatch.setattr(suffixes, "_run_pass", counted)
    rows = [(k, word(150) + text[k : 4000 - k] + word(150)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_substrings(df).collect()}
    assert found == brute_bytes(rows)
    assert sizes[0] < 40 * 4000 / 2


def test_passages_hold_every_string_once():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 99, 100, 101, 700, 5000]))) for _ in range(60)]
    raw, ends = suffixes._joined(texts)
    starts = [s for _, a, b, _ in zip(*suffixes.passages(raw, ends, 100), strict=True) for s in range(a, b - 99)]
    assert starts == [s for end, t in zip(ends.tolist(), texts, strict=True) for s in range(end - len(t), end - 99)]


def test_loser_tree_knows_shared_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        coded = [[(suffixes.common(a, b, 0), b) for a, b in zip([b"", *r], r, strict=False)] for r in runs]
        out = list(suffixes.LoserTree([iter(r) for r in coded]))
        keys = [k for _, k in out]
        assert keys == sorted(k for r in runs for k in r)
        assert [s for s, _ in out] == [suffixes.common(a, b, 0) for a, b in zip([b"", *keys], keys, strict=False)]


def test_runs_unpack_as_packed():
    entries = sorted((bytes([97 + k % 3]) * (40 + k % 60), b"l" * (k % 61), (k, -k, 2 * k)) for k in range(300))
    assert [(r, left, w) for _, r, left, w in suffixes._unpack(suffixes._pack(entries))] == entries


def test_long_strings_and_odd_ids(spark):
    """Lengths above one byte, a very long text, and ids that are no integers."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(700)
    rows = [(1, word(300) + "A" + shared), (2, shared[:399] + "B" + word(50)), (3, word(20) + "C" + shared[100:600] + "D"), (4, word(300_000) + "E" + shared)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.dedup_substrings(df, 400).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (500, 1), 4: (700, 1)}
    for bad in (lambda: suffixes.dedup_substrings(df, 20), lambda: suffixes.dedup_substrings(df, 1 << 16)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        suffixes.dedup_substrings(df.withColumn("doc_id", df["doc_id"].cast("string")))


def test_splitters_weigh_and_bound_a_hot_gram(spark, monkeypatch):
    rows = [(-1, b"hot" + b"x" * 37)] * 500 + [(-1, b"g%039d" % k) for k in range(200)]
    table = spark.createDataFrame(rows, "part int, gram binary")
    cuts = suffixes._splitters(spark, table, 4)
    assert cuts == sorted(set(cuts)) and b"hot" + b"x" * 37 in cuts and len(cuts) <= 3
    monkeypatch.setattr(suffixes, "SAMPLE", 40)
    assert len(suffixes._splitters(spark, table, 400)) < 100
