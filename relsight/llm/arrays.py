"""Vectorised text helpers that run inside Spark's Arrow tasks.

Every function works on a bounded slice of rows (``slices``), so a task's
memory follows the slice and the longest single text, not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

SLICE_BYTES = 2 << 20

# The separators of the word class [^\x20\x09-\x0D].
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(WORD_SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The five numbers of xxh64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return data[lo:hi], (offsets - lo if len(offsets) else np.zeros(1, np.int64))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    # A worker waits for its next task without the memory of this one.
    pa.default_memory_pool().release_unused()


def word_table(column: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a slice as one dictionary array, and row offsets into it."""
    data, offsets = text_buffers(column)
    if lower:
        data = _LOWER[data]
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[row_starts]
    kept = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begins)
    bounds = np.append(kept[starts], kept[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words.dictionary_encode(), np.searchsorted(starts, offsets, side="left")


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """xxh64 of each value, many at a time: step by step as its specification has short input; those of 32 bytes or more one by one."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    # Eight bytes from every place on, as numbers, past the last one too.
    padded = np.concatenate([raw[at[0] : at[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    starts, sizes = at[:-1] - at[0], np.diff(at)
    out = np.uint64(_PRIMES[4]) + sizes.astype(np.uint64)

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    one, two, three, four, five = (np.uint64(x) for x in _PRIMES)
    short = np.flatnonzero(sizes < 32)
    for k in (0, 8, 16):
        short = short[sizes[short] >= k + 8]
        if not len(short):
            break
        out[short] = turned(out[short] ^ (turned(eight[starts[short] + k] * two, 31) * one), 27) * one + four
    some = np.flatnonzero((sizes < 32) & (sizes & 4 > 0))
    out[some] = turned(out[some] ^ ((eight[starts[some] + (sizes[some] & ~7)] & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
    some = np.flatnonzero((sizes < 32) & (sizes & 3 > 0))
    for k in range(3):
        some = some[sizes[some] & 3 > k]
        out[some] = turned(out[some] ^ (padded[starts[some] + (sizes[some] & ~3) + k].astype(np.uint64) * five), 11) * one
    out = (out ^ (out >> np.uint64(33))) * two
    out = (out ^ (out >> np.uint64(29))) * three
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def hash_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and row offsets."""
    table, rows = word_table(column, lower)
    hashes = word_hashes(table.dictionary)
    codes = table.indices.to_numpy(zero_copy_only=False)
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64), rows


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a word-hash array (windows may span rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(words: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row.

    A row with fewer than k words has its whole sequence as one shingle; a row
    without words has the empty set.
    """
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every piece, one piece after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - shift, lengths)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, z): texts compressed one by one, for a shuffle that only some of them survive."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        yield pa.record_batch([batch.column("doc_id"), pa.array([press(t) for t in texts], pa.binary())], names=["doc_id", "z"])


def loosen(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The texts that ``squeeze`` has compressed, some rows at a time."""
    free = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield pa.record_batch([part.column("doc_id"), pa.array([free(z) for z in part.column("z").to_pylist()], pa.binary()).cast(pa.string())], names=["doc_id", "text"])
