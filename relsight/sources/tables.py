"""CSV files whose headers differ, in one scan, with line breaks inside quotes.

Lines are read by splits of files. Whether a split begins inside quotes
follows from the splits before it: each one leaves the state as it finds it,
swaps it, or sets it, whatever it was, and windows over the splits of a file
compose those. Then each split forms its records by itself; a record that
crosses splits comes in parts, which meet by file.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relsight.operators.shared import written
from relsight.sources.xz import opened, read_xz

#: Openers of compressed files, by their ends.
PACKED = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open, ".lzma": lzma.open}
XZ = (".xz", ".lzma")
#: Bytes of splits that one task goes through, where there are more than a few a core.
TASK = 64 << 20
BROKEN = (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path, folder or glob names, through Hadoop's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for found in files.globStatus(path) or []:
        inner = files.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [f.getPath().toString() for f in inner if not f.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def broken(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The compressed ones of files that can't be unpacked to their end, and why. Each is read through once, in tasks."""
    packed = [p for p in paths if p.lower().endswith(tuple(PACKED))]
    if not packed:
        return {}

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, problems = [], []
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as file, PACKED[path[path.rindex(".") :].lower()](file) as text:
                        while text.read(1 << 20):
                            pass
                except pa.ArrowInvalid:
                    continue  # a file system that only Spark reads
                except BROKEN as problem:
                    paths.append(path)
                    problems.append(f"{type(problem).__name__}: {problem}")
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(problems, pa.string())], names=["path", "problem"])

    files = spark.createDataFrame([(p,) for p in packed], "path string").repartition(len(packed))
    # A row a broken file.
    return {r.path: r.problem for r in files.mapInArrow(tried, "path string, problem string").collect()}


def headers(spark: SparkSession, paths: list[str]) -> tuple[dict[str, tuple[str, list[str]]], dict[str, str]]:
    """The first line of each file and its fields, and what is wrong with others."""
    found, problems = {}, {}
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for path in paths:
        try:
            if path.lower().endswith(XZ):
                with opened(path) as file, lzma.open(file, "rt", encoding="utf-8", errors="replace") as text:
                    line = text.readline().rstrip("\n")
            else:
                at = jvm.org.apache.hadoop.fs.Path(path)
                stream, codec = at.getFileSystem(conf).open(at), codecs.getCodec(at)
                stream = codec.createInputStream(stream) if codec else stream
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
                stream.close()
        except Exception as problem:  # of Hadoop or of a codec, as the JVM reports it
            problems[path] = f"can't be opened: {str(problem).splitlines()[0]}"
            continue
        line = line.removeprefix("\ufeff")
        found[path] = (line, next(csv.reader([line]), []))
    return found, problems


def scan(spark: SparkSession, paths: list[str], raw: bool) -> DataFrame:
    """value, file and block (where the split begins) of all lines; ``raw`` lines end at line feeds only."""
    plain, packed = [p for p in paths if not p.lower().endswith(XZ)], [p for p in paths if p.lower().endswith(XZ)]
    reader = spark.read.option("lineSep", "\n") if raw else spark.read
    parts = [reader.text(plain).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))] if plain else []
    parts += [read_xz(spark, packed, raw)] if packed else []
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes. Quotes open at the front of a field only; two inside are one character."""
    at = 0
    if not inside and not line.startswith('"'):
        at = line.find(',"') + 1
        if not at:
            return False
    at += not inside
    while True:
        end = line.find('"', at)
        while end >= 0 and line.startswith('"', end + 1):
            end = line.find('"', end + 2)
        if end < 0:
            return True
        # On to the next field that begins with a quote.
        comma = line.find(",", end + 1)
        while comma >= 0 and not line.startswith('"', comma + 1):
            comma = line.find(",", comma + 1)
        if comma < 0:
            return False
        at = comma + 2


def after(values: pa.Array, inside: bool) -> np.ndarray:
    """Whether each of some lines ends inside quotes, as ``inside_after`` has it.

    Quotes open and close in turn where each one that opens stands at the
    front of a field or right after one that closed, with which it is one
    character; other lines are gone through one by one.
    """
    ends, data = edges(values)
    quotes = np.flatnonzero(data == 34)
    line = np.searchsorted(ends, quotes, "right") - 1
    opening = quotes[int(inside) :: 2]
    before = data[opening - 1]
    if ((ends[line[int(inside) :: 2]] == opening) | (before == 44) | (before == 34)).all():
        return (np.cumsum(np.bincount(line, minlength=len(values))) + inside) % 2 == 1
    out = np.empty(len(values), bool)
    for i, value in enumerate(values.to_pylist()):
        inside = inside_after(value, inside) if '"' in value else inside
        out[i] = inside
    return out


def edges(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of an array begin (and the last one ends) in their bytes, and the bytes."""
    values = values.cast(pa.large_string())
    _, where, data = values.buffers()
    ends = np.frombuffer(where, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], held[ends[0] : ends[-1]]


def both(values: pa.Array, state: tuple[bool, bool]) -> tuple[bool, bool]:
    """The states after some lines from two states before them, which soon meet where there are quotes."""
    at = 0
    if state[0] != state[1]:
        ends, data = edges(values)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(data == 34), "right") - 1).tolist():
            value, at = values[i].as_py(), i + 1
            state = (inside_after(value, state[0]), inside_after(value, state[1]))
            if state[0] == state[1]:
                break
        else:
            return state
    if at < len(values):
        last = bool(after(values.slice(at), state[0])[-1])
        return last, last
    return state


def runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    differ = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differ |= np.diff(c.dictionary_encode().indices.to_numpy()) != 0
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), len(columns[0])]
    return zip(cuts[:-1], cuts[1:], strict=True)


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, and the states that a split leaves when it begins outside and inside."""
    now, state = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([state[0]]), pa.array([state[1]])], names=["file", "block", "out", "in"])

    for batch in batches:
        values, files, blocks = (batch.column(c) for c in ("value", "file", "block"))
        for first, last in runs(files, blocks) if batch.num_rows else ():
            found = files[first].as_py(), blocks[first].as_py()
            if found != now:
                if now:
                    yield row()
                now, state = found, (False, True)
            state = both(values.slice(first, last - first), state)
    if now:
        yield row()


def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits that know where they begin: whole ones (part 0), the end of an earlier split's (1), and the front of one that goes on (2)."""
    now, held, state, began = None, [], False, False

    def table(values: pa.Array, first: int) -> pa.RecordBatch:
        part = np.zeros(len(values), np.int32)
        part[0] = first
        return pa.record_batch([values, pa.repeat(pa.scalar(now, pa.int64()), len(values)), pa.array(part)], names=["value", "split", "part"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield table(pa.array(["\n".join(held)], pa.string()), 1 if began else 2)
            held.clear()

    for batch in batches:
        values, splits, insides = (batch.column(c) for c in ("value", "split", "inside"))
        for first, last in runs(splits) if batch.num_rows else ():
            if splits[first].as_py() != now:
                yield from rest()
                now, state = splits[first].as_py(), insides[first].as_py()
                began = state
            lines = values.slice(first, last - first)
            inside = after(lines, state)
            state, ends = bool(inside[-1]), np.flatnonzero(~inside) + 1
            if not len(ends):
                held += lines.to_pylist()
                continue
            head = pa.array(["\n".join(held + lines.slice(0, ends[0]).to_pylist())], pa.string())
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")
            yield table(pa.concat_arrays([head, whole.cast(pa.string())]), 1 if began else 0)
            began, held = False, lines.slice(ends[-1]).to_pylist()
    yield from rest()


def gathered(rows: DataFrame, paths: list[str]) -> DataFrame:
    """The same splits of files in fewer tasks, as many as their bytes and the cores ask for."""
    spark = rows.sparkSession
    conf, path = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(path(p).getFileSystem(conf).getFileStatus(path(p)).getLen() for p in paths)
    return rows.coalesce(max(4 * spark.sparkContext.defaultParallelism, size // TASK))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value and file of all records, whose quoted fields may hold line breaks."""
    rows = gathered(scan(spark, paths, True), paths)
    # At most a row a split, which stands for as many bytes as a task reads.
    splits = rows.mapInArrow(effects, "file string, block long, out boolean, in boolean")
    splits = written(splits.withColumn("split", F.monotonically_increasing_id()), "splits")
    # A split sets the state if both ways end alike, and swaps it if both end otherwise.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("swaps", F.sum((F.col("out") & ~F.col("in")).cast("int")).over(upto))
    setting = F.last(F.when(F.col("out") == F.col("in"), F.struct("out", "swaps")), ignorenulls=True).over(before)
    splits = splits.select("file", "block", "split", setting.alias("set"), F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0)).alias("had"))
    odd = (F.col("had") - F.coalesce("set.swaps", F.lit(0))) % 2 == 1
    splits = splits.select("file", "block", "split", (F.coalesce("set.out", F.lit(False)) != odd).alias("inside"))
    known = rows.join(F.broadcast(splits), ["file", "block"]).select("value", "split", "inside")
    parts = known.mapInArrow(formed, "value string, split long, part int").join(F.broadcast(splits.select("split", "file", "block")), "split")
    chain = F.sum((F.col("part") == 2).cast("int")).over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.where("part > 0").withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("x"))
    whole = parts.where("part = 0").select("value", "file").union(joined.select(F.array_join("x.value", "\n"), "file"))
    return whole.select(F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value"), "file")


def read_fields(spark: SparkSession, paths: list[str], required: list[str], optional: list[str], multi_line: bool) -> tuple[DataFrame, dict[str, str]]:
    """file and the named fields of all CSVs that have the required ones, and what is wrong with the others.

    Fields stand where each file's own header says. Lines that repeat the
    header are no rows.
    """
    found, problems = headers(spark, paths)
    for path, (_, names) in found.items():
        if missing := sorted(set(required) - set(names)):
            problems[path] = f"has no column {', '.join(missing)}"
    good = {p: h for p, h in found.items() if p not in problems}
    wanted = [*required, *optional]
    if not good:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("file", *wanted))), problems
    width = max(len(names) for _, names in good.values())
    rows = records(spark, list(good)) if multi_line else scan(spark, list(good), False)
    if len({line for line, _ in good.values()}) == 1:
        line, names = next(iter(good.values()))
        rows = rows.withColumn("head", F.lit(line))
        at = {c: F.col(f"c{names.index(c)}") if c in names else F.lit(None).cast("string") for c in wanted}
    else:
        # A row a file, by either way to write a local one: its header and where its fields are.
        places = [(p, line, *[names.index(c) if c in names else None for c in wanted]) for path, (line, names) in good.items() for p in {path, re.sub("^file:/(?=[^/])", "file:///", path), path.replace("file:///", "file:/")}]
        rows = rows.join(F.broadcast(spark.createDataFrame(places, "file string, head string, " + ", ".join(f"`at_{c}` int" for c in wanted))), "file")
        fields = F.array(*[F.col(f"c{i}") for i in range(width)])
        at = {c: F.when(F.col(f"at_{c}").isNotNull(), F.get(fields, F.col(f"at_{c}"))) for c in wanted}
    rows = rows.where(~F.col("value").isin(F.col("head"), F.concat(F.lit("\ufeff"), F.col("head")), F.lit("")))
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"', "multiLine": "true"})
    # Generated, so that a line is parsed once, not once for each use of a field in later filters.
    rows = rows.select(*[c for c in rows.columns if c not in ("value", "head")], F.inline(F.array(parsed)))
    return rows.select("file", *[at[c].alias(c) for c in wanted]), problems
