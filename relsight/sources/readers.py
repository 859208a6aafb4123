"""Readers of N-Triples text, edge and node CSVs, and small option files."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relsight.functions.iri import NT_LINE, canonical, strip
from relsight.sources import tables
from relsight.sources.tables import matching
from relsight.sources.xz import read_xz


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain, gz, bz2, xz or lzma text (``value``)."""
    if not path.lower().endswith((".xz", ".lzma")):
        return spark.read.text(path)
    return read_xz(spark, matching(spark, path)).select("value")


def parse_interesting(given: str) -> list[str]:
    """Names between commas, trimmed, without empty ones."""
    return [x.strip() for x in given.split(",") if x.strip()]


def parse_lines(lines: DataFrame) -> DataFrame:
    """s, p, o and bad (a line that is no triple) of lines that aren't empty and don't begin with #."""
    v = F.col("value")
    rows = lines.where((v != "") & ~v.startswith("#"))
    return rows.select(*[F.regexp_extract(v, NT_LINE, i).alias(n) for i, n in enumerate("spo", 1)]).withColumn("bad", F.col("p") == "")


def triples(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """s, p, o; ``seen`` counts the lines that are none (``skipped``) as the first action reads them."""
    return observed(parse_lines(lines), seen, "bad").where(~F.col("bad")).drop("bad")


def observed(rows: DataFrame, seen: Observation | None, bad: str) -> DataFrame:
    return rows.observe(seen, F.count_if(F.col(bad)).alias("skipped"), F.count("*").alias("rows")) if seen is not None else rows


def count_bad_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).agg(F.count_if("bad").alias("bad_lines"), F.count("*").alias("lines"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return triples(text_lines(spark, path))


EDGE_FIELDS = {"s": "node_id_start", "p": "rel_type", "o": "node_id_end"}


def read_edges(spark: SparkSession, path: str, multi_line: bool = False, seen: Observation | None = None) -> DataFrame:
    """edge_id, s, p, o of edge CSVs; rows with an empty field are dropped, and counted by ``seen``. With ``multi_line``, fields may hold line breaks."""
    rows, problems = tables.read_fields(spark, matching(spark, path), list(EDGE_FIELDS.values()), [], multi_line)
    for where, problem in problems.items():
        raise ValueError(f"{where} {problem}")
    return clean_edges(rows.select(*[F.col(c).alias(n) for n, c in EDGE_FIELDS.items()]), seen)


def clean_edges(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    # Generated, so that later filters take what has been stripped once.
    rows = rows.select(F.inline(F.array(F.struct(*[strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("s", "p", "o")]))))
    rows = observed(rows.withColumn("bad", F.expr("s = '' or p = '' or o = ''")), seen, "bad")
    return rows.where(~F.col("bad")).select(F.monotonically_increasing_id().alias("edge_id"), "s", "p", "o")


def read_nodes(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """node_id and category (type, or else from the file name) of node CSVs, all in one scan; unreadable files are left out whole, with a warning."""
    broken = tables.broken(spark, paths)
    rows, problems = tables.read_fields(spark, sorted(set(paths) - set(broken)), ["node_id"], ["type"], multi_line)
    for path, problem in sorted((broken | problems).items()):
        warnings.warn(f"skipped {path}: {problem}", stacklevel=2)
    # A folder of Spark's part files is one file by its own name.
    name = F.substring_index(F.regexp_replace("file", "/part-[^/]*$", ""), "/", -1)
    # nodes-X.csv gives X, other names lose what follows their last dot.
    stem = F.when(name.startswith("nodes-") & name.endswith(".csv"), F.regexp_replace(name, r"^nodes-|\.csv$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    kind, node = (strip(F.coalesce(c, F.lit(""))) for c in ("type", "node_id"))
    return rows.select(node.alias("node_id"), F.when(kind != "", kind).otherwise(stem).alias("category")).where("node_id <> ''")


def read_prefixes(path: str, defaults: dict[str, str]) -> dict[str, str]:
    """A JSON object of prefixes over the defaults; anything else is a warning."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("not an object")
        return defaults | {str(k): str(v) for k, v in found.items()}
    except (OSError, ValueError) as problem:
        warnings.warn(f"prefixes not read: {problem}", stacklevel=2)
        return dict(defaults)


def read_predicates(lines: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """display (canonical form, null if unrecognised) of a predicate list; comments and blanks are skipped."""
    v = strip(F.col("value"))
    return lines.where((v != "") & ~v.startswith("#")).select(v.alias("given"), canonical(v, prefixes).alias("display"))
