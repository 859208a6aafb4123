"""Line dedup by pairwise alignment.

Documents overlap when they share a line of at least MIN_WORDS words. A rare
line, one that at most RARE different texts hold, pairs each of them with all
earlier ones. A more frequent line first pairs a document with its earliest
holder and with the holder before it in one of several hashed runs of about
RUN holders. Where none of a document's partners aligns with such a line, as
other lines cross it, the line's other earlier holders follow in rounds, each
of about STEP times as many, drawn by hash, until one aligns or none is left.
So a document keeps all its copies of a long line only if no earlier document
aligns with any, as if all pairs were aligned; lines in the usual order cost
at most two pairs a document however many hold them.
Partners are aligned with patience diff over line hashes; a region without a
line that is unique on both sides is aligned by longest common subsequences,
of its long lines first. Aligned common blocks that contain such a line are
deleted from the later document. What depends on the partners met is how far
a block's short lines go with it, and which copies of a line that the
document repeats.

Documents are ordered by (doc_id, digest of the text), a null doc_id first.
Equal texts are one class, held by its earliest document; its later copies
align with it whole and lose all lines if any has MIN_WORDS words. Rows that
repeat both id and text are treated alike. A null text is empty and has one
empty line; an empty table gives no rows; other columns are carried, but for
one named as the result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import compress
from math import isqrt

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from relsight.llm.arrays import slices
from relsight.llm.shared import drop_written, fresh, salted_join, settings, small_batches, written

#: Words of a line that makes documents overlap, holders of a rare line, of a run of a frequent one, and growth of a round.
MIN_WORDS, RARE, RUN, STEP = 5, 8, 64, 8


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order.

    A row of the table of lengths is one number: bit j is clear where b[: j + 1]
    has more than b[:j]. Each isqrt(len(a))-th row is kept, and those between
    are made again on the way back.
    """
    at: dict[int, int] = {}
    for j, h in enumerate(b):
        at[h] = at.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1

    def below(row: int, h: int) -> int:
        up = row & at.get(h, 0)
        return ((row + up) | (row - up)) & full

    step = isqrt(len(a)) + 1
    kept, row = [full], full
    for i, h in enumerate(a, 1):
        row = below(row, h)
        if i % step == 0:
            kept.append(row)
    pairs = []
    i, j = len(a), len(b)
    while i and j:
        top = (i - 1) // step
        rows = [kept[top]]
        for h in a[top * step : i]:
            rows.append(below(rows[-1], h))
        while i > top * step and j:
            if rows[i - top * step] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if rows[i - top * step] >> (j - 1) & 1:
                j -= 1
                pairs.append((i, j))
    return pairs[::-1]


def patience(a: list[int], b: list[int], words: list[bool] | None = None) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the common blocks, in order; words: which lines of b are long."""
    match: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            match[b0] = a0
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            match[b1] = a1
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {h: i for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1}
        both = [(at[h], j) for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1 and h in at]
        if not both:
            shared = in_a.keys() & in_b.keys()
            large = {b[j] for j in range(b0, b1) if words and words[j]} & shared
            # Long lines first; the regions between them have none in common and are aligned by all lines.
            use = large or shared
            p, q = ([k for k in range(lo, hi) if x[k] in use] for x, lo, hi in ((a, a0, a1), (b, b0, b1)))
            i0, j0 = a0, b0
            for i, j in [*((p[i], q[j]) for i, j in common([a[i] for i in p], [b[j] for j in q])), (a1, b1)]:
                if large:
                    todo.append((i0, i, j0, j))
                if i < a1:
                    match[j] = i
                i0, j0 = i + 1, j + 1
            continue
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(both):
            x = bisect_left(tails, i)
            back.append(ends[x - 1] if x else -1)
            tails[x : x + 1], ends[x : x + 1] = [i], [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        i0, j0 = a0, b0
        for i, j in [*reversed(chain), (a1, b1)]:
            todo.append((i0, i, j0, j))
            if i < a1:
                match[j] = i
            i0, j0 = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for j in sorted(match):
        if blocks and blocks[-1][1] + blocks[-1][2] == j and blocks[-1][0] + blocks[-1][2] == match[j]:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((match[j], j, 1))
    return blocks


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair: the line numbers it deletes from its later document, their long lines, and the long lines it shares but can't align."""
    for batch in batches:
        gone: list[list[int]] = []
        taken: list[list[int]] = []
        crossed: list[list[int]] = []
        for a, b, words in zip(*(batch.column(c).to_pylist() for c in ("a_lines", "b_lines", "b_long")), strict=True):
            lost = [k for _, j, n in patience(a, b, words) if any(words[j : j + n]) for k in range(j, j + n)]
            met = {b[k] for k in lost if words[k]}
            gone.append(lost)
            taken.append(list(met))
            crossed.append(list(set(compress(b, words)).intersection(a) - met))
        lists = [pa.array(gone, pa.list_(pa.int32())), pa.array(taken, pa.list_(pa.int64())), pa.array(crossed, pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("id"), batch.column("partner"), *lists], names=["id", "partner", "gone", "taken", "crossed"])


def compared(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """What ``aligned`` gives for the pairs (id, first), without those that share no long line."""
    a = own.select(F.col("id").alias("first"), F.col("h").alias("a_lines"))
    b = own.select("id", F.col("h").alias("b_lines"), F.col("long").alias("b_long"))
    both = salted_join(pairs, a, "first").join(b, "id").select("id", F.col("first.doc_id").alias("partner"), "a_lines", "b_lines", "b_long")
    with settings(own.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=500):
        out = both.mapInArrow(aligned, "id struct<doc_id: long, key: binary>, partner long, gone array<int>, taken array<long>, crossed array<long>")
        return written(out.where((F.size("gone") > 0) | (F.size("crossed") > 0)), "gone")


def rounds(own: DataFrame, held: DataFrame, found: DataFrame) -> list[DataFrame]:
    """Further results like ``found``: lines that no partner aligned meet their other earlier holders, round by round.

    A round takes the holders whose hash falls in its share, so no holders are
    ranked in one task, and reads the lines of the round's documents alone.
    """
    crossed = F.array_except(F.array_distinct(F.flatten(F.collect_list("crossed"))), F.flatten(F.collect_list("taken")))
    left = written(found.groupBy("id").agg(crossed.alias("h")).select("id", F.explode("h").alias("h")), "left")
    out: list[DataFrame] = []
    if left.isEmpty():
        drop_written(left)
        return out
    some = written(held.join(left.select("h").distinct(), "h", "left_semi"), "some")
    counts = some.groupBy("h").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) / float(1 << 30)
    level = F.floor(F.log(1 + share * F.col("n") / RARE) / F.log(F.lit(float(STEP)))).cast("int")
    # Rare lines have met all holders.
    holders = salted_join(some, counts, "h", counts).where(F.col("n") > RARE).select("h", F.col("id").alias("first"), level.alias("level"))
    holders = written(holders, "holders")
    last = holders.agg(F.max("level")).first()[0]
    for k in range(0 if last is None else last + 1):
        pairs = left.join(holders.where(F.col("level") == k), "h").where(F.col("first") < F.col("id")).select("id", "first").distinct()
        pairs = written(pairs, "pairs")
        wanted = written(pairs.select(F.explode(F.array("id", "first")).alias("id")).distinct(), "wanted")
        lines = written(own.join(wanted, "id", "left_semi"), "lines")
        out.append(compared(lines, pairs))
        met = out[-1].select("id", F.explode("taken").alias("h")).distinct()
        before, left = left, written(left.join(met, ["id", "h"], "left_anti"), "left")
        for table in (before, pairs, wanted, lines):
            drop_written(table)
        if left.isEmpty():
            break
    for table in (left, some, holders):
        drop_written(table)
    return out


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """What changes: key (digest of a text), first_id (its earliest document), copies (whether later rows lose all), gone (line numbers), partners (doc_ids)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= min_words).alias("long")))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"), lines.alias("lines"))
    own = rows.groupBy("key").agg(F.min(F.struct("doc_id")).alias("d"), F.count("*").alias("rows"), F.first("lines").alias("lines"))
    own = written(own.select(F.struct(F.col("d.doc_id").alias("doc_id"), "key").alias("id"), "rows", F.col("lines.h").alias("h"), F.col("lines.long").alias("long")), "lines")

    held = own.select("id", F.explode(F.array_distinct(F.arrays_zip("h", "long"))).alias("x")).where("x.long").select("id", F.col("x.h").alias("h"))
    held = written(held, "held")
    shared = held.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = salted_join(held, shared, "h")
    # Each run is ordered by itself: a rare line is one run, a frequent one is split by a hash of its holders.
    run = F.when(F.col("n") > RARE, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / RUN))).otherwise(F.lit(0))
    order = Window.partitionBy("h", "run").orderBy("id")
    earlier = F.when(F.col("n") <= RARE, F.collect_list("id").over(order.rowsBetween(-RARE, -1))).otherwise(F.array_compact(F.array("first", F.lag("id").over(order))))
    pairs = met.withColumn("run", run).withColumn("earlier", earlier).select("id", F.explode("earlier").alias("first")).where("first <> id").distinct()
    pairs = written(pairs, "pairs")
    found = [compared(own, pairs)]
    found += rounds(own, held, found[0])
    gone = reduce(DataFrame.union, found).where(F.size("gone") > 0).withColumn("key", F.col("id.key"))
    gone_of = gone.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.array_sort(F.collect_set("partner")).alias("partners"))
    changed = own.select(F.col("id.key").alias("key"), F.col("id.doc_id").alias("first_id"), ((F.col("rows") > 1) & F.exists("long", lambda x: x)).alias("copies")).join(gone_of, "key", "left")
    out = written(changed.where("copies or gone is not null"), "changed")
    for table in (own, held, pairs, *found):
        drop_written(table)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, into: str = "dedup") -> DataFrame:
    """The rows of ``docs`` with deduplicated text, and the struct ``into``: n_lines, removed (line numbers), partners (doc_ids).

    Texts travel compressed to what changes in them.
    """
    small_batches(docs.sparkSession)
    found = deletions(docs, min_words)
    names = [c for c in docs.columns if c != into]
    row, z, key = (fresh(docs.columns, c) for c in ("row", "z", "key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias(row), F.col("text").cast("string").alias("text"), F.unhex(F.md5(text)).alias(key))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch([batch.column(row), batch.column(key), pa.array([None if t is None else press(t) for t in texts], pa.binary())], names=[row, key, z])

    kept = StructType([rows.schema[row], rows.schema[key]])
    joined = rows.mapInArrow(pressed, StructType([*kept, StructField(z, BinaryType())]))
    joined = joined.join(found.withColumnRenamed("key", key).hint("merge"), key, "left")
    copy = F.coalesce(F.col("copies"), F.lit(False)) & ~F.col(f"{row}.doc_id").cast("long").eqNullSafe(F.col("first_id"))
    none = F.array().cast("array<int>")
    joined = joined.select(row, z, copy.alias("copy"), F.when(copy, none).otherwise(F.coalesce("gone", none)).alias("gone"), F.when(copy, F.array("first_id")).otherwise(F.coalesce("partners", F.array().cast("array<long>"))).alias("partners"))

    def cut(batches: Iterator[pa.RecordBatch], most: int = 200) -> Iterator[pa.RecordBatch]:
        free = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                texts, numbers, gone = [], [], []
                for t, copied, lost in zip(*(batch.column(c).to_pylist() for c in (z, "copy", "gone")), strict=True):
                    t = None if t is None else free(t)
                    lines = (t or b"").split(b"\n")
                    lost = list(range(len(lines))) if copied else lost
                    if lost:
                        drop = set(lost)
                        t = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                    texts.append(t)
                    numbers.append(len(lines))
                    gone.append(lost)
                yield pa.record_batch([batch.column(row), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int32()), pa.array(gone, pa.list_(pa.int32())), batch.column("partners")], names=[row, "text", "n_lines", "removed", "partners"])

    added = [StructField("n_lines", IntegerType()), StructField("removed", ArrayType(IntegerType())), StructField("partners", ArrayType(LongType()))]
    out = StructType([rows.schema[row], rows.schema["text"], *added])
    done = joined.mapInArrow(cut, out)
    result = F.struct("n_lines", "removed", "partners").alias(into)
    return done.select(*[F.col("text") if c == "text" else F.col(row).getField(c).alias(c) for c in names], result)
