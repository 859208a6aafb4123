"""Best-fit packing certified by dual-feasible lower bounds.

Documents longer than a sequence are cut (the first piece may be shorter);
full pieces are sequences of their own. The other pieces are packed in
rounds: every group of about GROUP_ITEMS pieces runs best-fit decreasing and
compares its count with the best dual-feasible lower bound. Groups at their
bound are certified and done. In the others, the sequences with gaps are
opened again: their pieces are exchanged with those of other groups and
packed anew, until nothing is open, one group is left, or a round gains
nothing. Only per-round totals reach the driver.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each; a null doc_id stays null; an empty table gives no rows; the
string of an added token in a text is that token; other columns aren't read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsight.llm import pretokens
from relsight.llm.arrays import ragged, slices
from relsight.llm.shared import drop_written, small_batches, written

GROUP_ITEMS = 20_000
#: Pre-tokens whose ids a task remembers before it starts afresh; with SLICE it sets what a worker holds beside the JVM.
REMEMBERED = 80_000
#: Text whose pre-tokens are told apart at once.
SLICE = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def encoder(tokenizer_path: str):
    """Ids of one pre-token, by the merges of a tokenizer file (its ids are the merge ranks), and its added tokens' ids."""
    import json

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        found = json.load(f)
    added = {t["content"].encode(): t["id"] for t in found["added_tokens"]}
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in found["model"]["vocab"].items() if all(c in byte_of for c in token) and token.encode() not in added}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, added


def token_ids(column: pa.Array, encode, added: dict[bytes, int], known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a slice, and row offsets into them. Strings of added tokens stand apart in a text, with their own ids."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    apart = np.zeros(len(texts), bool)
    for token in added:
        apart |= np.asarray(pc.match_substring(texts, token))
    if apart.any():
        mark = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + b")")
        cut = [mark.split(t.as_py()) if x else [t.as_py()] for t, x in zip(texts, apart, strict=True)]
        ids, rows = token_ids(pa.array([y for x in cut for y in x[::2]], pa.large_binary()), encode, {}, known)
        out, sizes, at = [], [], 0
        for x in cut:
            own = []
            for k, part in enumerate(x):
                own.append(np.array([added[part]], np.uint32) if k % 2 else ids[rows[at] : rows[at + 1]])
                at += 1 - k % 2
            out += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])
    words, rows = pretokens.split(column)
    table = words.dictionary_encode()
    if len(known) > REMEMBERED:
        known.clear()
    ids = []
    for word in table.dictionary.to_pylist():
        found = known.get(word)
        if found is None:
            found = known[word] = encode(word.decode())
        ids.append(found)
    sizes = np.fromiter(map(len, ids), np.int64, count=len(ids))
    flat = np.fromiter((x for y in ids for x in y), np.uint32, count=int(sizes.sum()))
    codes = table.indices.to_numpy(zero_copy_only=False)
    each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    out = flat[ragged((np.cumsum(sizes) - sizes)[codes], each)] if len(codes) else np.zeros(0, np.uint32)
    return out, np.concatenate([[0], np.cumsum(each)])[rows]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids with the end id, cut to the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        encode, added = encoder(tokenizer_path)
        for batch in slices(batches, "text", SLICE):
            ids, rows = token_ids(batch.column("text"), encode, added, known)
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                out += [(doc, i, x, y - x, zlib.crc32(own[x:y].tobytes())) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual-feasible bounds: above capacity-k counts 1, below k counts 0, else its share."""
    count = np.bincount(lengths, minlength=capacity + 1)
    items = np.cumsum(count)
    mass = np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(0, capacity // 2 + 1)
    large = items[capacity] - items[capacity - k]
    middle = mass[capacity - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    return int(np.max(large + -(-middle // capacity)))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, bin_, n = capacity, n, n + 1
        left = room - size
        if not by_room[left]:
            bisect.insort(rooms, left)
        by_room[left].append(bin_)
        bins[i] = bin_
    return bins


def pack(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to pieces (rows of ``length``, a table that gives the same rows each time)."""
    columns = items.columns
    names = [*columns, "sequence_id", "offset", "open"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, open boolean"

    def packed(base: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            lengths = table["length"].to_numpy()
            bins = best_fit(lengths, capacity)
            used = np.bincount(bins, weights=lengths).astype(np.int64)
            certified = len(used) <= lower_bound(lengths, capacity)
            order = np.argsort(bins, kind="stable")
            total = np.cumsum(lengths[order])
            first = np.searchsorted(bins[order], np.arange(len(used)))
            offset = np.empty(len(lengths), np.int64)
            offset[order] = total - lengths[order] - (total - lengths[order])[first][bins[order]]
            gap = (used < capacity)[bins] & (not certified)
            # A certified group that isn't the last can still pass on its emptiest sequence.
            if certified and len(used):
                gap |= bins == int(np.argmin(used)) if used.min() < capacity else False
            ids = base + (key[0].as_py() << 24) + bins
            return table.select(columns).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("open", pa.array(gap))

        return run

    done = items.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + (1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    parts = [done.select(*names[:-1])]
    open_ = items.where(F.col("length") < capacity)
    n, round_, before = open_.count(), 0, None
    while n:
        groups = -(-n // group_items)
        # By the row's place in its table, so that rows of one id, or of none, aren't one group.
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
        result = written(open_.withColumn("g", deal).groupBy("g").applyInArrow(packed(round_ << 52), types), "packed")
        left = result.where("open")
        m, sequences = left.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if groups == 1 or m == 0 or (before is not None and sequences >= before):
            parts.append(result.select(*names[:-1]))
            break
        parts.append(result.where("not open").select(*names[:-1]))
        open_, n, before, round_ = left.select(*columns), m, sequences, round_ + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(written(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity, group_items)
