"""Operator 1: byte-level BPE encoding and decoding.

``encode`` turns whole texts into token ids, ``decode`` turns ids back into bytes.  The merges
are those of a rank file; the tokenizers library applies them to the distinct pre-tokens of each
Arrow batch, whose bytes are first mapped to the printable characters that the library's
byte-level models use.  ``decode`` reverses that table, so a character whose bytes fall into
several tokens comes back whole.

Nulls and empty texts give no ids and empty bytes.  Repeated rows and repeated ids are encoded
row by row.  Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import pretokens

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
#: Pre-tokens handed to the library at a time.
AT_ONCE = 4096


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + k) for k in range(256))
    return {b: chr(b) if b in printable else next(others) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def ragged(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slices values[begin:end], one after another."""
    sizes = ends - begins
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    return values[np.arange(total) + np.repeat(begins - (stops - sizes), sizes)]


class Pieces:
    """The byte table reversed: the bytes of every id, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {rank: token for token, rank in ranks.items()}
        order = range(max(by_id, default=-1) + 1)
        self.widths = np.array([len(by_id.get(k, b"")) for k in order], np.int64)
        self.begins = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(by_id.get(k, b"") for k in order), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.begins[ids], self.begins[ids] + self.widths[ids]).tobytes()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(read_ranks(path))


class Codec:
    """The tokenizers model of a rank file, with a memory of pre-tokens already encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        table = byte_characters()
        spelled = {token: "".join(table[b] for b in token) for token in ranks}
        # Any two known neighbours whose join is known may merge, in the order of the join's rank.
        merges = [
            (spelled[token[:k]], spelled[token[k:]])
            for token in sorted(ranks, key=ranks.get)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.model = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.to_characters = table
        self.pieces = pieces(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.bounds = np.zeros(1 << 14, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Encode new pre-tokens, each by itself, and remember their ids."""
        for k in range(0, len(fresh), AT_ONCE):
            some = fresh[k : k + AT_ONCE]
            mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_characters) for w in some]
            found = self.model.encode(mapped, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            first = len(self.known)
            while self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            while first + len(some) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), np.int64)])
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.bounds[first + 1 : first + len(some) + 1] = self.filled + np.cumsum(sizes)
            self.filled += len(ids)
            self.known.update(zip(some, range(first, first + len(some)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, per_text = pretokens.words(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = pretokens.look_up(self.known, words, self._learn)
        ids = ragged(self.flat, self.bounds[at], self.bounds[at + 1])
        ends = np.concatenate([[0], np.cumsum(self.bounds[at + 1] - self.bounds[at])])
        return np.split(ids, ends[np.cumsum(per_text)][:-1])

    def inside(self, ids: np.ndarray, text: bytes) -> int:
        """How many token boundaries lie inside a character: byte offsets against the byte-to-character map."""
        ends = np.cumsum(self.pieces.widths[ids])[:-1]
        return int(((np.frombuffer(text, np.uint8)[ends] & 0xC0) == 0x80).sum()) if len(ends) else 0

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets (first, one past the last) of each token, a split character being in each of its tokens."""
        ends = np.cumsum(self.pieces.widths[ids])
        heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        begins = ends - self.pieces.widths[ids]
        return heads[begins] - 1, heads[ends - 1]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pieces.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Codec(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Rows (key, ids, n_inside): ids as little-endian unsigned 32-bit integers in one binary value.

    ``n_inside`` counts token boundaries inside a character.  With ``offsets``, ``first`` and
    ``past`` hold the tokens' character offsets as arrays.  With ``decoded``, the bytes that the ids
    stand for follow, as ``decode`` gives them, without a second worker for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            done = 0
            for texts in pretokens.blocks(batch.column(1)):
                found = coder.encode(texts)
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                columns = [
                    batch.column(0).slice(done, len(texts)),
                    pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()),
                    pa.array([coder.inside(x, t) for x, t in zip(found, raw, strict=True)], pa.int64()),
                ]
                if offsets:
                    spans = [coder.offsets(x, t) for x, t in zip(found, raw, strict=True)]
                    columns += [pa.array([s[k].tolist() for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
                if decoded:
                    columns.append(pa.array([coder.decode(np.frombuffer(x.as_py(), "<u4")) for x in columns[1]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(texts)

    kinds = [T.StructField("ids", T.BinaryType()), T.StructField("n_inside", T.LongType())]
    if offsets:
        kinds += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("first", "past")]
    if decoded:
        kinds.append(T.StructField("decoded", T.BinaryType()))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *kinds])
    names = schema.fieldNames()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, ids, decoded, keep...): the bytes that the ids of ``encode`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for whole in batches:
            for k in range(0, len(whole), 500):
                batch = whole.slice(k, 500)
                texts = [table.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
                columns = [*batch.columns[:2], pa.array(texts, pa.binary()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [df.schema[key], df.schema["ids"], T.StructField("decoded", T.BinaryType()), *(df.schema[c] for c in keep)]
    names = [f.name for f in fields]
    return df.select(key, "ids", *keep).mapInArrow(run, T.StructType(fields))


def digest(bytes_column: Column) -> Column:
    return F.sha2(bytes_column, 256)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count and digests of the ids and of the bytes decoded from them."""
    back = encode(df, path, decoded=True)
    return back.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
        F.col("n_inside").alias("n_inside"),
    )
