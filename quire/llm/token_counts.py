"""Operator 9: token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged array of symbols.  In each round every
sequence finds its lowest-ranked adjacent pair and joins all its occurrences at once, from the
left; a sequence without a known pair leaves.  The symbols that survive are counted.

The vocabulary is a tokenizers ``.json`` file with a byte-level BPE model.  Its added tokens are
recognised inside texts as the library does by default and count as one token each.  Null and
empty texts have no tokens; repeated rows are counted row by row; only the id and text columns
are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import pretokens
from quire.llm.bpe_codec import REMEMBERED, byte_characters

FAR = np.iinfo(np.int64).max
#: Distinct pre-tokens merged at a time.
AT_ONCE = 1 << 15


class Counter:
    """The merge table of a vocabulary file, and the counts of pre-tokens seen."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined[order]
        table = byte_characters()
        self.letters = np.array([vocab[table[b]] for b in range(256)], np.int64)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or -1."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def merged(self, words: list[str]) -> np.ndarray:
        """How many symbols each word has after all merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        symbols = self.letters[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.array([len(r) for r in raw], np.int64)
        result = sizes.copy()
        rows = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            # Pairs within a sequence; the last symbol of each has none.
            found = np.full(len(symbols), -1, np.int64)
            inner = np.flatnonzero(rows[1:] == rows[:-1])
            found[inner] = self._find(symbols[inner], symbols[inner + 1])
            rank = np.where(found >= 0, self.ranks[found], FAR)
            heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            lowest = np.minimum.reduceat(rank, heads)
            spans = np.diff(np.r_[heads, len(symbols)])
            best = np.repeat(lowest, spans)
            live = best < FAR
            hit = live & (rank == best)
            # Overlapping occurrences (a a a) are joined from the left: every second one of a run.
            at = np.flatnonzero(hit)
            if len(at):
                run = np.r_[True, np.diff(at) > 1]
                place = np.arange(len(at))
                offset = place - np.maximum.accumulate(np.where(run, place, 0))
                at = at[offset % 2 == 0]
            symbols[at] = self.joined[found[at]]
            result -= np.bincount(rows[at], minlength=len(words))
            stay = live
            stay[at + 1] = False
            symbols, rows = symbols[stay], rows[stay]
        return result

    def _learn(self, fresh: list[str]) -> None:
        fresh.sort(key=len)  # sequences of a length end after about as many rounds
        for k in range(0, len(fresh), AT_ONCE):
            some = fresh[k : k + AT_ONCE]
            self.known.update(zip(some, self.merged(some).tolist(), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                extra[k] = len(pieces) - 1
            else:
                pieces = [text]
            parts += pieces
            owner += [k] * len(pieces)
        words, per_part = pretokens.words(parts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sizes = pretokens.look_up(self.known, words, self._learn)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(per_part)
        per = sums[ends] - sums[ends - per_part]
        return np.bincount(owner, weights=per, minlength=len(texts)).astype(np.int64) + extra


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens) for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teller = counter(path)
        for batch in batches:
            done = 0
            for texts in pretokens.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        batch.column(2).slice(done, len(texts)),
                        pa.array(teller.count(texts), pa.int64()),
                    ],
                    ["key", "n_bytes", "n_tokens"],
                )
                done += len(texts)

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), size.alias("n_bytes")).mapInArrow(run, schema).withColumnRenamed("key", key)


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
