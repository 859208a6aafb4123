"""Splits texts into the pre-tokens of byte-level BPE vocabularies.

The split is that of the pattern in ``public_tokenizers.PATTERN``:
contractions, then letters, numbers or other characters with at most one
leading space, then white space. It is computed over whole slices of texts
from runs of equal character class; pre-tokens cover a text without gaps, so
they are offsets into its own bytes.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from relsight.llm.arrays import text_buffers

# The code points of the pattern's white-space class.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)


@cache
def classes() -> np.ndarray:
    """The class of each code point; UNKNOWN where Python's tables, which may be old, have no character."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            table[i] = LETTER
        elif kind[0] == "N":
            table[i] = NUMBER
        elif kind == "Cn":
            table[i] = UNKNOWN
    table[WHITE_SPACE] = SPACE
    return table


def kinds(points: np.ndarray) -> np.ndarray:
    """The class of each character of a text; the library that applies the pattern is asked about unknown ones."""
    table = classes()
    found = table[points]
    unknown = np.unique(points[found == UNKNOWN])
    if len(unknown):
        table[unknown] = OTHER
        for mark, kind in (("a", LETTER), ("1", NUMBER)):
            table[unknown[like(mark, unknown)]] = kind
        found = table[points]
    return found


def like(mark: str, points: np.ndarray) -> np.ndarray:
    """Whether each code point is one pre-token together with ``mark``.

    The vocabulary merges ``mark`` with any first byte of a character, so a
    merge shows where the library has not split.
    """
    import public_tokenizers
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {mark.encode() + bytes([b]): 256 + b for b in range(0xC2, 0xF5)}
    encode = tiktoken.Encoding("marks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = np.array(encode("".join(f"{mark}{chr(i)}\n" for i in points.tolist())))
    return ids[np.concatenate([[0], np.flatnonzero(ids == 10)[:-1] + 1])] >= 256


def split(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All pre-tokens of a column's texts in order, and row offsets into them."""
    data, offsets = text_buffers(column)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(cps)
    rows = np.searchsorted(at, offsets)
    kind = kinds(cps)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    row_start[n] = True
    start = row_start[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[0] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    run_kind = kind[runs]
    # White space before more text: its last character stands apart, and a plain space joins what follows.
    inner = (run_kind == SPACE) & ~row_start[ends]
    last = ends[inner] - 1
    start[last] = True
    joins = cps[last] == 0x20
    start[last[joins] + 1] = False
    # Contractions begin at an apostrophe that is a run of its own and that no space has joined.
    i = runs[(run_kind == OTHER) & (ends - runs == 1) & ~row_start[ends]]
    i = i[(cps[i] == 0x27) & start[i] & (kind[np.minimum(i + 1, n - 1)] == LETTER)]
    one = cps[i + 1]
    has_two = (i + 2 < n) & ~row_start[np.minimum(i + 2, n)]
    two = np.where(has_two, cps[np.minimum(i + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[i[short | long] + 1] = False
    after = np.concatenate([i[short] + 2, i[long & ~short] + 3])
    start[after[after < n]] = True
    begins = np.flatnonzero(start)
    bounds = np.append(at[begins], len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(begins, rows)
