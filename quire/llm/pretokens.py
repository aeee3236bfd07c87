"""Vectorised pre-tokenisation for the byte-level BPE vocabularies.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
splits a text at changes of character class, with two exceptions: the last white-space
character before something else goes to that something if it is a plain space, and an
apostrophe that begins a match takes a known suffix with it.  Both are decided here for all
characters of a batch at once, on an array of code points.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)

# The Unicode White_Space code points.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contraction endings of the public pattern.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def starts(text: str, cuts: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins in ``text``, a run of texts whose first positions are ``cuts``.

    No pre-token crosses a cut.  ``cuts`` holds 0 and is sorted; empty texts repeat a position.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    begin = run[:n].copy()
    # The last of a run of white space, if something else follows in the same text.
    last = np.flatnonzero((kind == SPACE)[:-1] & run[1:n] & ~edge[1:n])
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    # An apostrophe that begins a match, and what follows it.
    marks = np.flatnonzero((points == 0x27) & begin)
    for ending in ENDINGS:
        k = len(ending)
        at = marks[marks + k < n]
        for j, letter in enumerate(ending, 1):
            at = at[(points[at + j] == ord(letter)) & ~edge[at + j]]
        begin[at + 1] = False
        after = at + 1 + k
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


def words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of ``texts`` in order, and how many each text has."""
    whole = "".join(texts)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], ends]).astype(np.int64)
    first = starts(whole, cuts[:-1][cuts[:-1] < len(whole)])
    stops = np.append(first[1:], [len(whole)] * (len(first) > 0)).astype(np.int64).tolist()
    found = [whole[a:b] for a, b in zip(first.tolist(), stops, strict=True)]
    return found, np.diff(np.searchsorted(first, cuts)).astype(np.int64)


def look_up(known: dict[str, int], words: list[str], learn) -> np.ndarray:
    """The known number of every word; ``learn`` adds those that are missing first."""
    found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(found < 0)
    if len(missing):
        fresh = [words[k] for k in missing.tolist()]
        learn(list(dict.fromkeys(fresh)))
        found[missing] = np.fromiter(map(known.__getitem__, fresh), np.int64, len(fresh))
    return found


def blocks(column, characters: int = 1 << 20):
    """The texts of an Arrow string column (null: empty) in lists of about so many characters."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held
