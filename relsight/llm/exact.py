"""Exact dedup over an extendible-hash index in shared files.

Keys are 64-bit hashes of whole texts. A directory of 2^depth slots starts
with one bucket; while a bucket is overfull it splits by its next key bit,
and the directory doubles when a bucket's local depth passes its own. Only
byte counts of key prefixes reach the driver, never keys; the directory, a
number a slot, goes to every task. Owner tasks then take contiguous ranges of
directory slots, chain the entries of equal keys, compare their bytes, and
write their part of the index to the shared folder. Rows find their bucket in
the directory and their key in that bucket of the index; bytes are compared
again only for keys that hold several different texts.

Defined cases: a null text is the empty text; the row with the largest
doc_id of equal texts stays (repeated rows with that doc_id all count as
kept); a null doc_id stays only if its whole group has none; an empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from relsight.llm.shared import drop_written, salted_join, written

#: Text bytes that a bucket may hold before it splits; more where a directory would pass MOST_BUCKETS.
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 1 << 16
#: Text bytes of the directory range that one owner task takes.
OWNER_BYTES = 32 << 20
#: Directory bits that one counting pass looks ahead.
BITS = 8
#: Copies in a batch that make a text hot, and bytes of hot texts that a task holds before it passes them on.
HOT, HOT_BYTES = 8, 16 << 20
INDEX = "key long, slot int, chain_text string, keep_id long, group_size long"


class Directory:
    """2^depth slots that name buckets; a bucket of local depth d fills 2^(depth - d) of them, side by side."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = np.zeros(1, np.int32)
        self.local = [0]
        self.size = [0]

    def double(self) -> None:
        """Every slot becomes two that name its bucket."""
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def span(self, bucket: int, slot: int) -> tuple[int, int]:
        """The slots of a bucket, from one of them."""
        width = 1 << (self.depth - self.local[bucket])
        return slot // width * width, width

    def split(self, bucket: int, slot: int) -> int:
        """A new bucket takes the upper half of an overfull one's keys; the directory doubles where one slot names it."""
        if self.local[bucket] == self.depth:
            self.double()
            slot *= 2
        at, width = self.span(bucket, slot)
        new = len(self.local)
        self.slots[at + width // 2 : at + width] = new
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        self.size.append(0)
        return new

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key."""
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.slots[((keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.depth)).astype(np.int64)]


def directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """The directory of a table of distinct keys (``key``, ``bytes``).

    A pass counts BITS bits beyond the local depth of overfull buckets, which
    then split until each fits or a next pass is needed; the driver gets at
    most 2^BITS counts for each of those. A single key never splits further.
    """
    found = Directory()
    total, n = keys.agg(F.sum("bytes"), F.count("*")).first()
    most = max(bucket_bytes, (total or 0) // MOST_BUCKETS)
    found.size[0] = total or 0
    overfull = {0} if found.size[0] > most and n > 1 else set()
    while overfull:
        shared = keys.sparkSession.sparkContext.broadcast(found)
        wanted = np.array(sorted(overfull), np.int32)
        local = np.array(found.local)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared, wanted=wanted, local=local) -> Iterator[pa.RecordBatch]:
            """bucket, the next bits of its keys, and their bytes."""
            for batch in batches:
                key = batch.column("key").to_numpy()
                bucket = shared.value.lookup(key)
                keep = np.isin(bucket, wanted)
                high = key[keep].view(np.uint64) ^ np.uint64(1 << 63)
                bits = (high << local[bucket[keep]].astype(np.uint64)) >> np.uint64(64 - BITS)
                yield pa.record_batch([pa.array(bucket[keep]), pa.array(bits.astype(np.int32)), pa.array(np.asarray(batch.column("bytes"))[keep])], names=["bucket", "bits", "bytes"])

        rows = keys.mapInArrow(counted, "bucket int, bits int, bytes long").groupBy("bucket", "bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        leaves: dict[int, np.ndarray] = {}
        for r in rows:
            leaves.setdefault(r.bucket, np.zeros((2, 1 << BITS), np.int64))[:, r.bits] = r.bytes, r.n
        overfull = set()
        for first, counts in leaves.items():
            open_ = [(first, counts)]
            while open_:
                bucket, under = open_.pop()
                size, keys_ = under.sum(axis=1).tolist()
                found.size[bucket] = size
                if size <= most or keys_ <= 1 or found.local[bucket] >= 64 - BITS:
                    continue
                if under.shape[1] == 1:
                    overfull.add(bucket)
                    continue
                new = found.split(bucket, int(np.flatnonzero(found.slots == bucket)[0]))
                half = under.shape[1] // 2
                open_ += [(bucket, under[:, :half]), (new, under[:, half:])]
    return found


def owners(found: Directory, owner_bytes: int = OWNER_BYTES) -> np.ndarray:
    """The owner of each bucket: contiguous directory ranges of whole buckets."""
    out = np.zeros(len(found.local), np.int32)
    owner, held = 0, None
    _, order = np.unique(found.slots, return_index=True)
    for bucket in found.slots[np.sort(order)].tolist():
        if held is not None and held + found.size[bucket] > owner_bytes:
            owner, held = owner + 1, None
        held = (held or 0) + found.size[bucket]
        out[bucket] = owner
    return out


def gathered(shared, owner_of: np.ndarray):
    """Each entry gets the owner that the directory names for its key.

    Copies within a batch become one entry, and those of a text that a batch
    holds HOT times or more one entry a task.
    """

    def entries(t: pa.Table) -> Iterator[pa.RecordBatch]:
        owner = owner_of[shared.value.lookup(t["key"].to_numpy())] if t.num_rows else np.zeros(0, np.int32)
        yield from t.add_column(0, "owner", pa.array(owner.astype(np.int32))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[tuple[int, str], list] = {}
        held = 0
        schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).group_by(["key", "text"]).aggregate([("doc_id", "max"), ("n", "sum")])
            t = pa.table([t["key"], t["text"], t["doc_id_max"], t["n_sum"]], schema=schema)
            many = pc.greater_equal(t["n"], HOT)
            for key, text, doc_id, n in zip(*(t.filter(many)[c].to_pylist() for c in t.column_names), strict=True):
                one = hot.get((key, text))
                if one is None:
                    hot[key, text] = [doc_id, n]
                    held += len(text)
                else:
                    one[0] = max((x for x in (one[0], doc_id) if x is not None), default=None)
                    one[1] += n
            yield from entries(t.filter(pc.invert(many)))
            if held > HOT_BYTES:
                yield from entries(flush(hot, schema))
                hot, held = {}, 0
        if hot:
            yield from entries(flush(hot, schema))

    def flush(hot: dict, schema: pa.Schema) -> pa.Table:
        columns = zip(*((key, text, doc_id, n) for (key, text), (doc_id, n) in hot.items()), strict=True)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries, sorted by key: chain equal keys and compare their bytes.

    Only the open key's chain of different texts is held.
    """
    schema = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("chain_text", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    open_key: int | None = None
    chain: list[list] = []
    out: list[tuple] = []

    def close() -> None:
        out.extend((open_key, i, text if len(chain) > 1 else None, keep, n) for i, (text, keep, n) in enumerate(chain))

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        keys, ids, sizes = (batch.column(c).to_pylist() for c in ("key", "doc_id", "n"))
        texts = batch.column("text")
        for i, key in enumerate(keys):
            if key != open_key:
                close()
                open_key, chain = key, []
            text = texts[i].as_py()
            for entry in chain:
                if entry[0] == text:
                    entry[1] = max((x for x in (entry[1], ids[i]) if x is not None), default=None)
                    entry[2] += sizes[i]
                    break
            else:
                chain.append([text, ids[i], sizes[i]])
        if len(out) > 20_000:
            yield flush()
    close()
    if out:
        yield flush()


def keyed(docs: DataFrame, key_of: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", key_of(F.col("text")))


def build_index(docs: DataFrame, key_of: Callable[[Column], Column] = F.xxhash64, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> tuple[DataFrame, Directory]:
    """The index in shared files and its directory: bucket, key, slot in its chain, chain_text (only in chains of several), keep_id, group_size."""
    rows = keyed(docs, key_of)
    # Each pass counts this table of numbers; texts are read once for it and once for the index.
    keys = written(rows.groupBy("key").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")), "keys")
    found = directory(keys, bucket_bytes)
    drop_written(keys)
    owner_of = owners(found, owner_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    entries = rows.select("key", "text", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(gathered(shared, owner_of), "owner int, key long, text string, doc_id long, n long")
    owned = entries.repartitionById(int(owner_of.max()) + 1, "owner").drop("owner")
    index = owned.sortWithinPartitions("key").mapInArrow(chained, INDEX)
    return written(addressed(index, shared), "index"), found


def addressed(rows: DataFrame, shared) -> DataFrame:
    """``rows`` with the bucket that the directory (a broadcast one) names for ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = shared.value.lookup(batch.column("key").to_numpy()).astype(np.int32)
            yield pa.record_batch([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])

    return rows.mapInArrow(run, StructType([StructField("bucket", IntegerType()), *rows.schema]))


def exact_dedup(docs: DataFrame, key_of: Callable[[Column], Column] = F.xxhash64, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    index, found = build_index(docs, key_of, bucket_bytes, owner_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    rows = keyed(docs, key_of).select("doc_id", "key", "text", F.sha2("text", 256).alias("text_sha256"))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    # A key's row of the index has its number of rows, so those of hot keys are dealt to several tasks.
    def looked_up(some: DataFrame, entries: DataFrame) -> DataFrame:
        sizes = entries.groupBy("key").agg(F.sum("group_size").alias("n"))
        return salted_join(addressed(some, shared), entries.drop("slot").withColumnRenamed("bucket", "at"), "key", sizes).where("bucket = at")

    result = looked_up(rows.drop("text"), index.where("chain_text is null").drop("chain_text")).select(*columns)
    chains = index.where("chain_text is not null")
    if chains.isEmpty():
        return result
    return result.union(looked_up(rows, chains).where("text = chain_text").select(*columns))
