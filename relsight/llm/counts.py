"""Token counts through a cache keyed by digests.

A row's key is the SHA-256 of its text and the version of the tokenizer, the
SHA-256 of its file. Keys are joined to the counts that the cache holds; of
the distinct ones it lacks, one text each travels to a task that encodes it,
and their counts are appended to the cache as a batch of their own, so that
writers don't disturb each other. Then every row finds its count by its key.

Counts are those of the tokenizer's own library. A sentencepiece model whose
pieces have blanks at their front only and that leaves characters as they are
can't join anything over the front of a blank run, so its texts are cut there
and each distinct part is encoded once by the library; other tokenizers get
whole texts.

Defined cases: a null text is the empty text; repeated rows and null ids are
counted each; a text has one count, however many rows hold it; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsight.llm.arrays import slices, text_buffers
from relsight.llm.shared import drop_written, salted_join, shared_dir, small_batches, written

#: Parts of texts that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of missing keys, at 64 each, that may be sent to every task.
SENT_BYTES = 8 << 20
BLANK = "▁"


def version(tokenizer_path: str) -> str:
    """The digest of a tokenizer file."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@cache
def counter(tokenizer_path: str) -> Callable[[pa.Array], np.ndarray]:
    """The numbers of tokens of a column of texts, by the library that the file is for."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        if separable(model):
            return by_parts(encode)
    else:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(tokenizer_path)
        found.no_truncation()
        found.no_padding()
        encode = lambda texts: [len(x) for x in found.encode_batch(texts, add_special_tokens=False)]
    return lambda column: np.array(encode(column.fill_null("").to_pylist()), np.int64)


def separable(model) -> bool:
    """Whether no piece joins something with a blank after it, and all characters and blanks stay as they are."""
    if any(BLANK in model.id_to_piece(i).lstrip(BLANK) for i in range(model.get_piece_size())):
        return False
    every = "".join(chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return all(model.normalize(x) == BLANK + x.replace(" ", BLANK) for x in (every, "  a  b  ", " ", BLANK))


def by_parts(encode: Callable[[list[str]], list[int]]) -> Callable[[pa.Array], np.ndarray]:
    """Counts as sums over parts, each of which begins with a run of blanks; the library puts the first blank of a text there itself."""
    # A lone blank at a text's end: to the library it is no text of its own.
    with_blank, without = encode(["a ", "a"])
    alone = {b" ": with_blank - without, BLANK.encode(): with_blank - without}
    known: dict[bytes, int] = dict(alone)

    def count(column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        full = offsets[1:] > offsets[:-1]
        begins = offsets[:-1][full]
        data = np.insert(data, begins, 0x20)
        begins = begins + np.arange(len(begins))
        if not len(data):
            return np.zeros(len(column), np.int64)
        blank = data == 0x20
        wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        for i in range(3):
            blank[wide + i] = True
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begins] = True
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(data)).astype(np.int64)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        parts = table.dictionary.to_pylist()
        if len(known) > REMEMBERED:
            known.clear()
            known.update(alone)
        new = [p for p in parts if p not in known]
        # A part without its first blank, which the library puts before every text.
        found = dict(zip(new, encode([p.decode().removeprefix(" " if p[:1] == b" " else BLANK) for p in new]), strict=True))
        sizes = np.array([found[p] if p in found else known[p] for p in parts], np.int64)
        known.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
        total = np.concatenate([[0], np.cumsum(sizes[table.indices.to_numpy(zero_copy_only=False)])])
        rows = np.zeros(len(column), np.int64)
        edge = np.searchsorted(starts, np.append(begins, len(data)))
        rows[full] = total[edge[1:]] - total[edge[:-1]]
        return rows

    return count


def encoded(tokenizer_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("digest"), pa.array(count(batch.column("text")), pa.int64())], names=["digest", "n_tokens"])

    return run


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """digest and n_tokens of a cache's folder for one version, or nothing where it has none. Writers that ran at once may both have a digest, with one count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    found = spark.read.schema("digest binary, n_tokens long").parquet(f"{folder}/*")
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``cache`` is a folder that driver and executors share; without one, a
    fresh cache in the shared folder serves this call alone.
    """
    spark = docs.sparkSession
    folder = f"{cache or f'{shared_dir(spark)}/relsight/token-counts-{uuid.uuid4().hex}'}/{version(tokenizer_path)}".rstrip("/")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = written(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    distinct = written(keys.groupBy("digest").agg(F.count("*").alias("n")), "digests")
    encode(rows.select("digest", "text"), distinct.select("digest"), tokenizer_path, folder)
    counts = stored(spark, folder)
    if counts is None:
        counts = spark.createDataFrame([], "digest binary, n_tokens long")
    out = salted_join(keys, counts, "digest", distinct)
    drop_written(distinct)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def encode(texts: DataFrame, distinct: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Append the counts of the digests that the cache's folder lacks."""
    spark = texts.sparkSession
    known, missing = stored(spark, folder), None
    if known is not None:
        missing = written(distinct.join(known, "digest", "left_anti"), "missing")
        n = missing.count()
        if not n:
            drop_written(missing)
            return
        if n * 64 <= SENT_BYTES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    # One text of a digest leaves each map task, so that copies meet in its partial aggregate.
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if missing is not None and n * 64 > SENT_BYTES:
        once = once.join(missing.hint("merge"), "digest", "left_semi")
    small_batches(spark)
    once.mapInArrow(encoded(tokenizer_path), "digest binary, n_tokens long").write.parquet(f"{folder}/batch={uuid.uuid4().hex}")
    if missing is not None:
        drop_written(missing)
