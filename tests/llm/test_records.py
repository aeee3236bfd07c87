import base64
import hashlib
import random

import numpy as np
import pytest

from quire.llm import chat_format, quality, queries, warc
from quire.llm.chat_format import locate, parse_turns, render_turns, unescape


def test_warc_round_trip(spark):
    rows = [(3, "http://www.A.example/x?q#f", "same"), (9, "https://a.example:8080/x", "same"), (4, "http://b.example/y", "ü\r\n\r\nWARC/1.1"), (5, None, None), (6, "u", ""), (None, "z", "same"), (9, "dup id", "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    found = warc.captured(spark, df).collect()
    told = sorted((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers"])) for r in found)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert told == sorted([
        (3, 4, digest("same"), "revisit", "9"), (9, 4, digest("same"), "response", "None"), (4, len("ü\r\n\r\nWARC/1.1".encode()), digest("ü\r\n\r\nWARC/1.1"), "response", "None"),
        (5, 0, digest(""), "revisit", "6"), (6, 0, digest(""), "response", "None"), (9, 5, digest("other"), "response", "None"),
    ])
    order = [(r["key"], r["stamp"], r["page"]) for r in sorted(found, key=lambda r: (r["range"], r["number"]))]
    assert order == sorted(order)
    assert warc.captured(spark, df.limit(0)).collect() == []
    assert warc.url_key("http://www.A.example/x?q#f") == "example,a)/x?q" and warc.url_key("https://u@a.example:8080") == "example,a:8080)/"


def test_index_merges_many_runs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(2)
    rows = [(k, f"http://{'hot' if rng.random() < 0.4 else rng.randrange(50)}.example/", f"p{rng.randrange(300)}") for k in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    found = sorted(warc.captured(spark, df).collect(), key=lambda r: (r["range"], r["number"]))
    assert [r["page"] for r in found] == [p for _, _, p in sorted((warc.url_key(u), warc.stamp(k), k) for k, u, _ in rows)]
    assert len({r["archive"] for r in found}) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damaged_archive_is_refused():
    good = warc.record(1, 0, "u", 0, b"x", None)
    assert [f["X-Page-ID"] for _, _, f, _ in warc.parse(good + good)] == ["1", "1"]
    with pytest.raises(ValueError):
        list(warc.parse(good[:-1] + b"!"))


def test_turns_read_back():
    rng = random.Random(1)
    pieces = ["###", "</turn>", "\\", ":", "a", " ", "\n", "<", "/turn>", "é", "\x01", "### Assistant: "]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a:\\"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(1, 5))]
        out, spans, loss, rewritten = locate(turns, render_turns, "assistant")
        assert parse_turns(out) == turns and not rewritten
        assert [unescape(out[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
        assert "".join(out[a:b] for a, b in spans) == out


def test_templates_are_black_boxes():
    turns = [("u", "a"), ("assistant", "b"), ("u", "c")]
    ended = lambda t: "".join(f"<{r}>{x}</{r}>" for r, x in t) + "<end>"
    out, spans, loss, rewritten = locate(turns, ended, "assistant")
    assert not rewritten and [out[a:b] for a, b in spans] == ["<u>a</u>", "<assistant>b</assistant>", "<u>c</u>"] and [out[a:b] for a, b in loss] == ["b"]
    only_last = lambda t: "".join(f"<{x if k == len(t) - 1 else '-'}>" for k, (_, x) in enumerate(t))
    assert locate(turns, only_last, "assistant")[3]


def test_chats_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "z"), (2**62 + 1, 3, "assistant", "y" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()
    assert found[None]["loss_sha256"] == hashlib.sha256(b"z").hexdigest() and found[2**62 + 1]["loss_chars"] == 20_000
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_chat_query_holds_the_extra_conversation(spark):
    row = queries.op7_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert (row["n_turns"], row["loss_chars"]) == (2, len("\\### Assistant: </turn> ok"))


def held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted, rest = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    model = quality.train(docs, fitted, quality.graded())
    scored = quality.score(docs, model).withColumn("ok", quality.accepted())
    return scored.join(rest.withColumn("grade", quality.graded()), "doc_id").groupBy("grade", "ok").count().collect(), model


def test_quality_on_held_out_labels(spark):
    counts, model = held_out(spark, "/root/testdata/sf0.1")
    share = lambda g, ok: sum(r["count"] for r in counts if r["grade"] == g and r["ok"] == ok) / sum(r["count"] for r in counts if r["grade"] == g)
    assert share(2, True) > 0.98 and share(0, False) > 0.9 and share(1, False) > 0.85
    assert (np.diff(model.thresholds) >= 0).all()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "w " * 50_000, "x"), (None, "a", "x")], "doc_id long, text string, tails string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, quality.graded()) is None
    out = quality.score(docs, None).withColumn("ok", quality.accepted()).collect()
    assert len(out) == 4 and all(r["ok"] and r["expected_grade"] is None for r in out)
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, both, quality.graded())).collect()
    assert len(scored) == 4 and all(0 <= r["tails"][1] <= r["tails"][0] <= 1 for r in scored)


def test_fit_reaches_the_optimum():
    """Against plain proximal gradient steps on dense features, run until they stand still."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 12)) < 0.25
    true = rng.normal(size=12) * 2
    noisy = x @ true + rng.logistic(size=300)
    grades = (noisy > np.quantile(noisy, 0.3)).astype(int) + (noisy > np.quantile(noisy, 0.7))
    lasso = 1e-3
    fitted = quality.fit([np.flatnonzero(r).astype(np.uint32) for r in x], grades, 3, rounds=3000, lasso=lasso, most=1.0)

    def objective(w, gaps):
        tails = quality.Model(w, gaps).tails(x @ w)
        ends = np.hstack([np.ones((300, 1)), tails, np.zeros((300, 1))])
        return np.log(ends[np.arange(300), grades] - ends[np.arange(300), grades + 1]).mean() - lasso * np.abs(w).sum()

    w, gaps = np.zeros(12), np.array([-1.0, 1.0])
    for _ in range(20_000):
        by_score, by_gap = quality.slopes(x @ w, gaps, grades)
        w = w + 0.2 * (x.T @ by_score) / 300
        w = np.sign(w) * np.maximum(np.abs(w) - 0.2 * lasso, 0)
        gaps = gaps + 0.2 * by_gap / 300
    step = 1e-5
    for k in range(2):  # the derivatives are those of the objective
        moved = gaps + step * (np.arange(2) == k)
        assert abs((objective(w, moved) - objective(w, gaps)) / step - quality.slopes(x @ w, gaps, grades)[1][k] / 300) < 1e-3
    assert objective(fitted.weights[:12], fitted.thresholds) > objective(w, gaps) - 1e-3


def test_fit_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"{'good' if k % 2 else 'bad'} w{k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, quality.graded(), slots=1) is None
    assert quality.train(docs, labels, quality.graded()) is not None
    assert quality.train(docs.limit(0), labels, quality.graded()) is None
    assert quality.score(docs.limit(0), None).collect() == []
