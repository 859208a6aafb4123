"""Byte-level BPE over Spark: every distinct pre-token is encoded once.

``encode`` explodes texts into pre-tokens with their positions, a block of
documents at a time. A block's distinct pre-tokens go to a global shuffle by
hash chunk, packed a row for each (block, chunk), where every distinct
pre-token is encoded once; the ids return to the blocks they came from. The
positions of each block's pre-tokens go straight to the block's group, which
joins ids and positions and reassembles the documents by position. No row is
keyed by a pre-token, so " the" isn't a hot key. ``decode`` looks each id up
in the token-byte table, whose size is that of the vocabulary.

The input is read twice and must give the same rows in the same order each
time, as a table does; blocks are named by a digest of their content, so a
table that doesn't fails instead of giving wrong ids.

Nulls and empty texts have no ids. Repeated rows are encoded each. A null
identifier stays null. Other columns of the input aren't carried.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from relsight.llm import pretokens
from relsight.llm.arrays import ragged, slices
from relsight.llm.shared import small_batches

#: Text that one block of documents holds, about.
BLOCK_BYTES = 6 << 20
#: Hash chunks of pre-tokens.
CHUNKS = 1024
#: Distinct pre-tokens of a chunk whose ids a task holds at once; a chunk with more encodes some again.
REMEMBERED = 400_000


@cache
def encoding(path: str):
    """The vocabulary of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative integers; offsets of the pieces that begin at ``starts``."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for shift in (7, 14, 21, 28):
        size += v >= np.uint64(1 << shift)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(5):
        more = size > k
        byte = (v[more] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[:-1][more] + k] = (byte | ((size[more] > k + 1) * np.uint64(0x80))).astype(np.uint8)
    return out, at[np.append(starts, len(v))]


def unpack(data: np.ndarray) -> np.ndarray:
    """The integers that ``pack`` has packed."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 0x80
    begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    return np.add.reduceat((data & 0x7F).astype(np.int64) << (7 * place), begin)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data))])


def joined(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, one after another."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)


def cut(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> pa.Array:
    """A compressed binary value for each group of consecutive pieces; ``groups`` are piece indices."""
    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    raw = memoryview(np.ascontiguousarray(data))
    at = offsets[groups].tolist()
    return pa.array([squeeze(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def uncut(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column that ``cut`` made, and row offsets into them."""
    loosen = zstandard.ZstdDecompressor().decompress
    parts = [loosen(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, count=len(parts)))]).astype(np.int64)


class Block:
    """A slice of documents: its distinct pre-tokens in chunk order."""

    def __init__(self, batch: pa.RecordBatch):
        words, self.rows = pretokens.split(batch.column("text"))
        ids = batch.column("doc_id")
        self.header = b"".join((np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype("<i8").tobytes(), np.diff(self.rows).astype("<i8").tobytes()))
        content = xxhash.xxh3_128(self.header)
        content.update(joined(batch.column("text").fill_null("")))
        self.name = content.digest()
        table = words.dictionary_encode()
        self.codes = table.indices.to_numpy(zero_copy_only=False)
        self.n = len(table.dictionary)
        chunk = np.fromiter((zlib.crc32(w) % CHUNKS for w in table.dictionary.to_pylist()), np.int64, count=self.n)
        self.place = np.argsort(chunk, kind="stable")
        self.chunk = chunk[self.place]
        self.words = table.dictionary.take(pa.array(self.place))

    def word_rows(self) -> list[pa.Array]:
        """chunk, block, first (place of the row's first pre-token), words, shape (their bytes)."""
        lengths = np.asarray(pa.compute.binary_length(self.words)).astype(np.int64)
        shape, shape_at = pack(lengths, np.arange(self.n))
        first = np.flatnonzero(np.concatenate([[True], self.chunk[1:] != self.chunk[:-1]]))
        groups = np.append(first, self.n)
        return [pa.array(self.chunk[first].astype(np.int32)), pa.array([self.name] * len(first), pa.binary()), pa.array(first), cut(joined(self.words), np.concatenate([[0], np.cumsum(lengths)]), groups), cut(shape, shape_at, groups)]

    def position_row(self) -> list[pa.Array]:
        """block, first (-1), header, shape (bytes of each pre-token's positions), positions as gaps."""
        rank = np.empty(self.n, np.int64)
        rank[self.place] = np.arange(self.n)
        token = rank[self.codes] if self.n else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")
        starts = np.searchsorted(token[order], np.arange(self.n))
        gaps = np.diff(order, prepend=0)
        gaps[starts] = order[starts]
        packed, at = pack(gaps, starts)
        shape, shape_at = pack(np.diff(at), np.arange(self.n))
        return [pa.array([self.name], pa.binary()), pa.array([-1], pa.int64()), pa.array([self.header], pa.binary()), cut(shape, shape_at, np.array([0, self.n])), cut(packed, at, np.array([0, self.n]))]


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BLOCK_BYTES):
        block = Block(batch)
        if block.n:
            yield pa.record_batch(block.word_rows(), names=["chunk", "block", "first", "words", "shape"])


def position_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BLOCK_BYTES):
        yield pa.record_batch(Block(batch).position_row(), names=["block", "first", "ids", "shape", "positions"])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed integers of a column, and how many each row has."""
    data, at = uncut(column)
    done = np.concatenate([[0], np.cumsum(data < 0x80)])
    return unpack(data), np.diff(done[at])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids array<int>): ids as the rank file's library would give them, without special tokens."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(ranks_path).encode_ordinary
        chunk, known = None, {}
        for batch in batches:
            lengths, per_row = unpacked(batch.column("shape"))
            ends = np.cumsum(lengths)
            data = uncut(batch.column("words"))[0].tobytes()
            chunks = np.repeat(batch.column("chunk").to_numpy(zero_copy_only=False), per_row).tolist()
            ids = []
            for c, a, b in zip(chunks, (ends - lengths).tolist(), ends.tolist(), strict=True):
                if c != chunk or len(known) > REMEMBERED:
                    chunk, known = c, {}
                word = data[a:b]
                found = known.get(word)
                if found is None:
                    found = known[word] = one(word.decode())
                ids.append(found)
            sizes = np.fromiter(map(len, ids), np.int64, count=len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int64, count=int(sizes.sum()))
            groups = np.concatenate([[0], np.cumsum(per_row)])
            packed, at = pack(flat, np.cumsum(sizes) - sizes)
            shape, shape_at = pack(sizes, np.arange(len(sizes)))
            yield pa.record_batch([batch.column("block"), batch.column("first"), cut(packed, at, groups), cut(shape, shape_at, groups), pa.nulls(batch.num_rows, pa.binary())], names=["block", "first", "ids", "shape", "positions"])

    def reassembled(table: pa.Table) -> pa.Table:
        table = table.sort_by("first").combine_chunks()
        first = table["first"].to_numpy()
        times = int((first == -1).sum())
        if not times:
            raise ValueError("the input gave other rows when it was read again")
        # Blocks of equal content have one name; each is given back.
        table = table.filter(pa.array(np.concatenate([[True], first[1:] != first[:-1]]))).combine_chunks()
        head = np.frombuffer(table["ids"][0].as_py(), "<i8").reshape(3, -1)
        counts = head[2]
        total = int(counts.sum())
        edges, out = np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.int64)
        if total:
            spans, _ = unpacked(table["shape"].slice(0, 1))
            packed, _ = uncut(table["positions"].slice(0, 1))
            sizes, _ = unpacked(table["shape"].slice(1))
            flat, _ = unpacked(table["ids"].slice(1))
            gaps = unpack(packed)
            ends = np.concatenate([[0], np.cumsum(packed < 0x80)])[np.cumsum(spans)]
            begin = np.concatenate([[0], ends[:-1]])
            run = np.cumsum(gaps)
            reps = ends - begin
            word = np.empty(total, np.int32)
            word[run - np.repeat(run[begin] - gaps[begin], reps)] = np.repeat(np.arange(len(sizes), dtype=np.int32), reps)
            del run, gaps, packed
            each = sizes[word]
            out = flat[ragged((np.cumsum(sizes) - sizes)[word], each)].astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out.astype(np.int32)))
        return pa.concat_tables([pa.table({"doc_id": pa.array(head[0], mask=head[1].astype(bool)), "ids": lists})] * times)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = rows.mapInArrow(word_rows, "chunk int, block binary, first long, words binary, shape binary")
    dealt = words.repartition("chunk").sortWithinPartitions("chunk")
    parts = "block binary, first long, ids binary, shape binary, positions binary"
    both = dealt.mapInArrow(encoded, parts).union(rows.mapInArrow(position_rows, parts))
    return both.groupBy("block").applyInArrow(reassembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The columns of ``encoded`` with ``ids`` replaced by their ``bytes``.

    The token-byte table has one row for each vocabulary entry, whatever the
    input, so every task holds it. Null ids give empty bytes.
    """
    rest = [c for c in encoded.columns if c != "ids"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(ranks_path)
        table: list[bytes | None] = [None] * (max(known.values()) + 1)
        for token, rank in known.items():
            table[rank] = token
        tokens = pa.array(table, pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            flat = tokens.take(lists.flatten())
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            inner = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(flat)))]) if len(flat) else np.zeros(1, np.int64)
            yield pa.record_batch([*[batch.column(c) for c in rest], binary(joined(flat), inner[at])], names=[*rest, "bytes"])

    schema = StructType([encoded.schema[c] for c in rest] + [StructField("bytes", BinaryType())])
    return encoded.select(*rest, "ids").mapInArrow(decoded, schema)
