"""Operator 10: exact substring dedup on a sparse suffix array.

Every byte covered by a string of ``length`` bytes that also starts earlier is removed; earlier is
a smaller document id, or an earlier start in the same document.  Strings are judged on the input,
and none crosses documents.

A sparse suffix array is enough: of all runs of ``GRAM`` bytes in a string of ``length`` bytes, the
one with the smallest hash (the first, on a tie) anchors it, and equal strings have equal anchors in
the same place.  So only suffixes at anchors are sorted, each with the bytes to its right and left
that strings with this anchor reach.

Passages that repeat as a whole meet first, so that a text which is copied often is sorted once.
Some anchors, chosen by their hash, cut a text into passages; each reaches over the strings that start
in it, so every string lies in one.  Hashes that occur again set bits of a filter; the passages in it
are exchanged by hash and compared byte by byte.  All but the first of equal ones are covered, and
what starts in them starts earlier too, so only the first passages and the texts between go on.

1. One pass hashes all anchors.  The hashes that occur again set bits of a filter of fixed size;
   anchors outside it are unique, and so is every string they anchor.
2. A second pass takes the other anchors' suffixes, sorts them in runs of bounded size, keeps equal
   ones of a run once (the later ones are covered), and front-codes the runs: each suffix is stored
   as the length of the prefix it shares with the one before, and the rest.
3. Runs are cut at splitters from a bounded sample and exchanged by range.  A loser tree merges the
   runs of a range; each contender carries the length of the prefix that it shares with the last
   winner, so known prefixes are never compared again.  Suffixes come out with the length of their
   common prefix; where it reaches the anchor's length, they have the same anchor, and for every
   place of the anchor in a string the first start is found among them.
4. The covered intervals go back to their documents.

Ids are integers of any width; other types are refused.  Null texts count as empty.  Null ids come first in order and stay null.  Rows that repeat both id
and text are one document: neither covers the other.  Texts shorter than ``length`` lose nothing.
Only the id and text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import cut, discard, partitions, release, sampled, written

#: Bytes of an anchor.
GRAM = 40
#: Bits of an anchor's hash that are compared; the highest ones, above 32, are its range.
HASH_BITS = 40
#: Bits of the filter of repeated anchors: a broadcast of 16 MB whatever the input.
FILTER_BITS = 27
#: Suffixes, or bytes of text, in one sorted run at most; bytes hashed at a time, as many as caches hold, and bytes whose rows go out together.
RUN_ENTRIES, RUN_BYTES, AT_ONCE, OUT_ONCE = 60_000, 32 << 20, 1 << 16, 1 << 20
#: One anchor in so many begins a passage.
PASSAGE = 4
#: Effort of compression.
LEVEL = 3
#: Anchors in the sample for splitters at most.
SAMPLE = 20_000
#: Cells of the filter of documents that lose something: a broadcast of fixed size.
CELLS = 1 << 20
NO_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))
    down = np.multiply.accumulate(np.full(n, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))
    return up, down


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes and their inverses; most blocks share one size."""
    return _powers_of(1 << max(18, (n - 1).bit_length()))


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that begin at each place."""
    n = len(raw)
    up, down = _scales(n)
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])
    out = sums[GRAM - 1 :].copy()
    out[1:] -= sums[: n - GRAM]
    out *= down[: n - GRAM + 1]
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def anchors(raw: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts that end at ``ends`` in ``raw``: (text, first, last, anchor, hash) of each run of starts with one anchor."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    counts = np.maximum(ends - begins - length + 1, 0)
    if not counts.sum():
        return none
    hashes = _grams(np.frombuffer(raw, np.uint8))
    width = length - GRAM + 1
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(keys) // width) + 1
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(rows, width)
    onward = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(keys)], onward[width - 1 : width - 1 + len(keys)])
    text = np.repeat(np.arange(len(ends)), counts)
    starts = np.arange(len(text)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    lasts = np.r_[heads[1:], len(starts)] - 1
    return text[heads], starts[heads], starts[lasts], anchor[heads], hashes[anchor[heads]]


def passages(raw: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts that end at ``ends`` in ``raw``: (text, begin, end, hash) of each passage."""
    text, first, last, _, hashes = anchors(raw, ends, length)
    if not len(text):
        return text, first, last, hashes
    heads = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | ((hashes[1:] >> np.uint64(7)) % np.uint64(PASSAGE) == 0)])
    begin, end = first[heads], np.r_[last[heads[1:] - 1], last[-1]] + length
    up, down = _scales(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[end] - sums[begin]) * down[begin]
    value ^= value >> np.uint64(32)
    value *= _ODD
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return text[heads], begin, end, value


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has the hashes."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([len(t) for t in texts]).astype(np.int64)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("body"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw")
    )


def _hash_pass(table: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """Rows (part, once, again, gram): hashes of a block by range, and now and then an anchor's bytes; with ``whole``, of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray], rows: list[tuple]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) >> np.uint64(64 - HASH_BITS), return_counts=True)
            part = (values >> np.uint64(32)).astype(np.int64)
            values = values.astype(np.uint32)  # the range has the other bits
            edges = np.searchsorted(part, np.arange((1 << HASH_BITS - 32) + 1))
            for k in range(1 << HASH_BITS - 32):
                if edges[k] < edges[k + 1]:
                    own, many = values[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]] > 1
                    rows.append((k, own[~many].tobytes(), own[many].tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "once", "again", "gram"])

        held, rows, size = [], [], 0
        for batch in batches:
            for _, texts in _blocks(batch.column(0).to_pylist()):
                raw, ends = _joined(texts)
                anchor, hashes = (None, passages(raw, ends, length)[3]) if whole else anchors(raw, ends, length)[3:]
                held.append(hashes)
                rows += [] if whole else [(-1, None, None, raw[p : p + GRAM]) for p in anchor[hashes % np.uint64(1021) == 0].tolist()]
                size += len(raw)
                if size >= OUT_ONCE:
                    yield out(held, rows)
                    held, rows, size = [], [], 0
        if held:
            yield out(held, rows)

    return table.select("raw").mapInArrow(run, "part int, once binary, again binary, gram binary")


def _repeated(hashed: DataFrame) -> bytearray:
    """The filter: a bit for each repeated hash, by its highest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: int, once: list[bytes], again: list[bytes]) -> tuple[int, bytes]:
            values, counts = np.unique(np.frombuffer(b"".join(once), np.uint32), return_counts=True)
            found = np.concatenate([values[counts > 1], np.frombuffer(b"".join(again), np.uint32)]).astype(np.uint64)
            found |= np.uint64(part << 32)
            return part, np.unique(found >> np.uint64(HASH_BITS - FILTER_BITS)).astype("<u4").tobytes()

        part, once, again, done = None, [], [], []
        for batch in batches:
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != part and part is not None:
                    done.append(packed(part, once, again))
                    once, again = [], []
                part = k
                once.append(x)
                again.append(y)
        if part is not None:
            done.append(packed(part, once, again))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], ["part", "bits"])

    dealt = hashed.where("part >= 0").select("part", "once", "again").repartition("part").sortWithinPartitions("part")
    bits = np.zeros(1 << FILTER_BITS, bool)
    # Per range at most its share of the filter's bits: a bound that the input does not move.
    for row in dealt.mapInArrow(run, "part int, bits binary").toLocalIterator():
        bits[np.frombuffer(row["bits"], "<u4")] = True
    return bytearray(np.packbits(bits, bitorder="little").tobytes())


_SEGMENT = "kind int, doc long, body long, at long, raw binary"
_SEGMENT_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_SEGMENT_KINDS)], ["kind", "doc", "body", "at", "raw"])


def _between(table: DataFrame, length: int, wanted) -> DataFrame:
    """Rows of kind 0: what is left of each text without the passages in the filter, each piece with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        rows, size = [], 0
        for batch in batches:
            docs, bodies, all_texts = (c.to_pylist() for c in batch.columns)
            for base, texts in _blocks(all_texts):
                raw, ends = _joined(texts)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                text, begin, end, value = passages(raw, ends, length)
                keep = np.flatnonzero(~_set(bits, value))
                # Passages that follow each other are one piece.
                first = np.flatnonzero(np.r_[True, (np.diff(keep) > 1) | (np.diff(text[keep]) > 0)]) if len(keep) else keep
                last = np.r_[first[1:] - 1, len(keep) - 1] if len(keep) else keep
                own = text[keep[first]]
                places = zip(own.tolist(), begins[own].tolist(), begin[keep[first]].tolist(), end[keep[last]].tolist(), strict=True)
                rows += [(0, docs[base + k], bodies[base + k], a - zero, raw[a:b]) for k, zero, a, b in places]
                size += len(raw)
                if size >= OUT_ONCE:
                    yield _segments(rows)
                    rows, size = [], 0
        if rows:
            yield _segments(rows)

    return table.mapInArrow(run, _SEGMENT)


def _later(found: dict[tuple[int, int], list[tuple[int, int]]], one: tuple, two: tuple, size: int) -> None:
    """Cover the later one of two equal passages."""
    if one != two:
        doc, body, place = max(one, two)
        found.setdefault((doc, body), []).append((place, place + size))


def _passage_pass(table: DataFrame, length: int, wanted, parts: int) -> DataFrame:
    """Rows of kind 0 (passages in the filter, packed, with their part as the place) and 1 (covered intervals of a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bits = np.frombuffer(wanted.value, np.uint8)
        held: dict[bytes, tuple] = {}
        where: dict[int, list[bytes]] = {}
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, where, found, size
            rows = _covers(found)
            for part, own in where.items():
                numbers = np.array([(*held[x], len(x)) for x in own], np.int64)
                packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([numbers.T.tobytes(), *own]))
                rows.append((0, None, None, part, struct.pack("<I", len(own)) + packed))
            held, where, found, size = {}, {}, {}, 0
            yield _segments(rows)

        for batch in batches:
            docs, bodies, all_texts = (c.to_pylist() for c in batch.columns)
            for base, texts in _blocks(all_texts):
                raw, ends = _joined(texts)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                text, begin, end, value = passages(raw, ends, length)
                keep = np.flatnonzero(_set(bits, value))
                own = text[keep]
                part = ((value[keep] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).tolist()
                for k, zero, a, b, r in zip(own.tolist(), begins[own].tolist(), begin[keep].tolist(), end[keep].tolist(), part, strict=True):
                    passage, place = raw[a:b], (docs[base + k], bodies[base + k], a - zero)
                    known = held.get(passage)
                    if known is None:
                        where.setdefault(r, []).append(passage)
                    else:
                        _later(found, known, place, b - a)
                    held[passage] = place if known is None else min(known, place)
                size += len(raw)
                if size >= RUN_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return table.mapInArrow(run, _SEGMENT)


def _first_pass(pieces: DataFrame) -> DataFrame:
    """Rows of kind 0 (the first of equal passages) and 1 (covered intervals of a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def firsts(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, tuple] = {}
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for piece in packed:
                (n,) = struct.unpack_from("<I", piece)
                raw = zstandard.ZstdDecompressor().decompress(piece[4:])
                at = 32 * n
                for doc, body, place, size in np.frombuffer(raw, np.int64, 4 * n).reshape(4, n).T.tolist():
                    passage, own = raw[at : at + size], (doc, body, place)
                    at += size
                    known = held.setdefault(passage, own)
                    _later(found, known, own, size)
                    if own < known:
                        held[passage] = own
            rows = [(0, *own, passage) for passage, own in held.items()] + _covers(found)
            for k in range(0, len(rows), 10_000):
                yield _segments(rows[k : k + 10_000])

        part, packed = None, []
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            done = [k for k, kind in enumerate(kinds) if kind == 1]
            if done:
                yield batch.take(pa.array(done))
            for kind, k, piece in zip(kinds, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if kind == 1:
                    continue
                if k != part and part is not None:
                    yield from firsts(packed)
                    packed = []
                part = k
                packed.append(piece)
        if part is not None:
            yield from firsts(packed)

    return pieces.mapInArrow(run, _SEGMENT)


# A run: for each suffix the length shared with the one before, the rest of it, the bytes to the
# left, and where it is from.
def _pack(entries: list[tuple]) -> bytes:
    import zstandard

    rights = [e[0] for e in entries]
    shared = [0] + [common(a, b, 0) for a, b in zip(rights[:-1], rights[1:], strict=True)]
    rests = [r[s:] for r, s in zip(rights, shared, strict=True)]
    numbers = np.array([(s, len(r), len(e[1])) for s, r, e in zip(shared, rests, entries, strict=True)], "<u2")
    where = np.array([e[2] for e in entries], np.int64)
    parts = [numbers.T.tobytes(), where.T.tobytes(), b"".join(rests), b"".join(e[1] for e in entries)]
    return struct.pack("<I", len(entries)) + zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def _unpack(run: bytes) -> Iterator[tuple]:
    """(shared, right, left, (doc, body, anchor)) in order."""
    import zstandard

    (n,) = struct.unpack_from("<I", run)
    raw = zstandard.ZstdDecompressor().decompress(run[4:])
    shared, rests, lefts = np.frombuffer(raw, "<u2", 3 * n).reshape(3, n).tolist()
    where = np.frombuffer(raw, np.int64, 3 * n, 6 * n).reshape(3, n).T.tolist()
    at = 30 * n
    other = at + sum(rests)
    right = b""
    for s, r, k, w in zip(shared, rests, lefts, where, strict=True):
        right = right[:s] + raw[at : at + r]
        yield s, right, raw[other : other + k], tuple(w)
        at += r
        other += k


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    size = min(len(a), len(b))
    if a[known:size] == b[known:size]:
        return size
    x = int.from_bytes(a[known:size], "little") ^ int.from_bytes(b[known:size], "little")
    return known + ((x & -x).bit_length() - 1) // 8


class LoserTree:
    """Merge of sorted runs of (shared, key, ...) whose ``shared`` refers to the item before in its run.

    Yields the items in order, with ``shared`` referring to the item that came out before.  Of two
    contenders, the one that shares more with the last winner is smaller; only if both share as
    much are the bytes behind compared.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.items: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length is then with the winner."""
        x, y = self.items[a], self.items[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        s, t = self.shared[a], self.shared[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        k, one, two = common(x[1], y[1], s), x[1], y[1]
        less = one[k:] < two[k:] or (one[k:] == two[k:] and a < b)
        winner, loser = (a, b) if less else (b, a)
        self.shared[loser] = k
        return winner, loser

    def __iter__(self) -> Iterator[tuple]:
        nodes = {self.size + k: k for k in range(self.size)}
        for node in range(self.size - 1, 0, -1):
            nodes[node], self.losers[node] = self._play(nodes[2 * node], nodes[2 * node + 1])
        winner = nodes[1]
        while self.items[winner] is not None:
            item = self.items[winner]
            yield (self.shared[winner], *item[1:])
            fresh = next(self.runs[winner], None) if winner < len(self.runs) else None
            self.items[winner] = fresh
            self.shared[winner] = fresh[0] if fresh else 0
            node = (winner + self.size) >> 1
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node >>= 1


def _intervals(found: list[tuple[int, int]]) -> bytes:
    """Overlapping or touching intervals joined, as pairs of 32-bit integers."""
    out: list[int] = []
    for a, b in sorted(found):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return np.array(out, "<i4").tobytes()


_COVER = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("body", T.LongType())])
_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _COVER.fieldNames())


def _covers(found: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple]:
    return [(1, doc, body, None, _intervals(spans)) for (doc, body), spans in found.items()]


def _covered(found: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple]:
    return [(1, None, _intervals(spans), doc, body) for (doc, body), spans in found.items()]


def _run_pass(table: DataFrame, length: int, wanted, splitters) -> DataFrame:
    """Rows of kind 0 (a piece of a front-coded run for a range) and 1 (covered intervals of a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        bits = np.frombuffer(wanted.value, np.uint8)
        cuts = splitters.value
        entries: dict[tuple[bytes, bytes], tuple] = {}
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entries, found, size
            ordered = sorted((right, left, where) for (right, left), where in entries.items())
            rows, first = _covered(found), 0
            while first < len(ordered):
                part = bisect_right(cuts, ordered[first][0][:GRAM])
                past = first
                if part < len(cuts):
                    low, past = first, len(ordered)
                    while low < past:
                        middle = (low + past) // 2
                        low, past = (middle + 1, past) if ordered[middle][0][:GRAM] < cuts[part] else (low, middle)
                else:
                    past = len(ordered)
                rows.append((0, part, _pack(ordered[first:past]), None, None))
                first = past
            entries, found, size = {}, {}, 0
            yield _batch(rows)

        for batch in batches:
            docs, bodies, places, all_texts = (c.to_pylist() for c in batch.columns)
            for base, texts in _blocks(all_texts):
                raw, ends = _joined(texts)
                # Where each text would begin if it were whole.
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) - np.array(places[base : base + len(texts)], np.int64)
                text, first, last, anchor, hashes = anchors(raw, ends, length)
                keep = np.flatnonzero(_set(bits, hashes))
                rows = zip(text[keep].tolist(), first[keep].tolist(), last[keep].tolist(), anchor[keep].tolist(), begins[text[keep]].tolist(), strict=True)
                for k, a, b, p, zero in rows:
                    name = (raw[p : b + length], raw[a:p])
                    where = (docs[base + k], bodies[base + k], p - zero)
                    known = entries.get(name)
                    if known is None or where < known:
                        entries[name] = where
                    if known is not None:  # the later of the two is covered by the other
                        doc, body, place = max(where, known)
                        if where[:2] != known[:2] or where[2] != known[2]:
                            place -= p - a
                            found.setdefault((doc, body), []).append((place, place + len(name[0]) + len(name[1])))
                size += len(raw)
                if len(entries) >= RUN_ENTRIES or size >= RUN_BYTES:
                    yield from flush()
        if entries or found:
            yield from flush()

    return table.mapInArrow(run, _COVER)


def _settle(group: list[tuple], length: int, found: dict) -> None:
    """Cover what, among suffixes of one anchor, starts earlier in another."""
    group.sort(key=lambda e: e[2])
    whole: dict = {}
    seen: dict = {}
    alike = all(e[0] == group[0][0] and e[1] == group[0][1] for e in group)
    for right, left, where in group:
        doc, body, p = where
        known = whole.setdefault((right, left), where)
        if known is not where:  # all strings here start earlier in the equal suffix
            if known != where:
                found.setdefault((doc, body), []).append((p - len(left), p + len(right)))
            continue
        if alike:
            continue
        spans: list[tuple[int, int]] = []
        for o in range(max(0, length - len(right)), len(left) + 1):
            first = seen.setdefault((left[len(left) - o :], right[: length - o]), where)
            if first is not where:
                spans.append((p - o, p - o + length))
        if spans:
            found.setdefault((doc, body), []).extend(spans)


def _merge_pass(pieces: DataFrame, length: int) -> DataFrame:
    """Covered intervals from the merge of each range's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(runs: list[bytes]) -> list[tuple]:
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            group: list[tuple] = []
            for shared, *entry in LoserTree([_unpack(r) for r in runs]):
                if shared < GRAM and group:
                    if len(group) > 1:
                        _settle(group, length, found)
                    group = []
                group.append(tuple(entry))
            if len(group) > 1:
                _settle(group, length, found)
            return _covered(found)

        part, runs = None, []
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            done = [k for k, kind in enumerate(kinds) if kind == 1]
            if done:
                yield batch.take(pa.array(done))
            for kind, k, piece in zip(kinds, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 1:
                    continue
                if k != part and part is not None:
                    yield _batch(merged(runs))
                    runs = []
                part = k
                runs.append(piece)
        if part is not None:
            yield _batch(merged(runs))

    return pieces.mapInArrow(run, _COVER)


def _splitters(spark: SparkSession, hashed: DataFrame, parts: int) -> list[bytes]:
    """Grams that cut the anchors into ranges of like size; each gram is drawn once, with its count."""
    counted = cut(hashed.where("part < 0").groupBy("gram").count())
    drawn = sorted((bytes(r["gram"]), r["count"]) for r in sampled(counted, SAMPLE, "gram", "count"))
    ends = np.cumsum([n for _, n in drawn])
    return sorted({drawn[np.searchsorted(ends, ends[-1] * k // parts, "right")][0] for k in range(1, parts)}) if drawn else []


def covered(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, body, spans): for each document that loses bytes, its covered intervals, packed and joined."""
    spark = docs.sparkSession
    if not GRAM <= length < 1 << 16:
        raise ValueError(f"length must be from {GRAM} to {(1 << 16) - 1}")
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer column, which orders the documents")
    found, firsts = _covered_by(_documents(docs, key, text), length)
    spans = cut(found.groupBy("doc", "body").agg(F.collect_list("run").alias("spans")))
    discard(firsts)
    del found
    release(spark)
    return spans


def _filter(hashed: DataFrame):
    return hashed.sparkSession.sparkContext.broadcast(bytes(_repeated(hashed)))


def _covered_by(table: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, body, run) of covered intervals, and the table that they are read from."""
    spark, parts = table.sparkSession, partitions(table.sparkSession)
    hashed = written(_hash_pass(table.select("raw"), length, whole=True))
    wanted = _filter(hashed)
    discard(hashed)
    dealt = F.coalesce("at", F.pmod(F.xxhash64("doc", "body"), F.lit(parts)))
    packed = _passage_pass(table.select("doc", "body", "raw"), length, wanted, parts).withColumn("at", dealt)
    firsts = written(_first_pass(packed.repartition("at").sortWithinPartitions("at", "kind")))
    del packed
    segments = _between(table.select("doc", "body", "raw"), length, wanted).unionByName(firsts.where("kind = 0"))
    hashed = written(_hash_pass(segments.select("raw"), length))
    repeated = _filter(hashed)
    splitters = spark.sparkContext.broadcast(_splitters(spark, hashed, 4 * parts))
    discard(hashed)
    # Intervals that a run covers by itself go along with the pieces, so the runs are made once.
    coded = _run_pass(segments.select("doc", "body", "at", "raw"), length, repeated, splitters)
    spread = F.coalesce("part", F.pmod(F.xxhash64("doc", "body"), F.lit(4 * parts)).cast("int"))
    pieces = coded.withColumn("part", spread).repartition("part").sortWithinPartitions("part", "kind")
    whole = firsts.where("kind = 1").select("doc", "body", F.col("raw").alias("run"))
    return _merge_pass(pieces, length).select("doc", "body", "run").unionByName(whole), firsts


def _cleaned(hit: DataFrame, kind) -> DataFrame:
    """Rows (key, kept, n_bytes, n_removed, n_spans) of documents with intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for raw, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = np.frombuffer(b"".join(packed or []), "<i4").reshape(-1, 2)
                joined = np.frombuffer(_intervals([tuple(p) for p in pairs.tolist()]), "<i4").reshape(-1, 2).tolist()
                at, parts = 0, []
                for a, b in joined:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(len(joined))
            sizes = pa.array([k + len(x) for k, x in zip(removed, kept, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names)

    names = ["key", "kept", "n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([T.StructField("key", kind), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in names[2:])])
    return hit.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kept, n_bytes, n_removed, n_spans), one per document; ``kept`` is what is left, in bytes."""
    spans = covered(docs, length, key, text)
    table = _documents(docs, key, text).withColumn("key", F.when(F.col("doc") != NO_ID, F.col("doc")).cast(docs.schema[key].dataType))
    cell = F.pmod(F.xxhash64("doc", "body"), F.lit(CELLS)).alias("cell")
    cells = F.broadcast(spans.select(cell).distinct())  # at most CELLS rows
    placed = table.withColumn("cell", cell)
    spared = placed.join(cells, "cell", "left_anti").select("key", F.col("raw").alias("kept"), F.length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    hit = placed.join(cells, "cell", "left_semi").join(spans, ["doc", "body"], "left").select("key", "raw", "spans")
    return spared.unionByName(_cleaned(hit, docs.schema[key].dataType)).withColumnRenamed("key", key)
