"""The corpus pipeline: five stages over ``documents``, each one of the operators.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame with the columns of ``documents``, but for the last,
which returns the packed pieces. Each stage is written as Parquet and read
again as the next one's docs.

Defined cases, the same for all stages: extra columns are carried, whatever
their names; a null doc_id stays a row of its own; null and empty texts are
clean but for what the classifier says of them; repeated rows are copies; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsight.llm import jaccard, lines, packing, pii, quality
from relsight.llm.shared import drop_written, fresh, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score below 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "quality", ~quality.held_out())
    score = fresh(docs.columns, "quality_score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document that loses all its text goes with them."""
    into = fresh(docs.columns, "dedup")
    out = lines.line_dedup(docs, into=into)
    same = F.size(f"{into}.removed") == 0
    out = out.where(same | F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    return out.select(*counted(docs, same))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, and one of its rows of each text.

    A row without an id is in no group and stays.
    """
    found = jaccard.jaccard_join(docs.select("doc_id", "text"))
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "again")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids that several rows have are rare, so few rows travel to become one.
    several = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(several)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets."""
    into = fresh(docs.columns, "pii")
    found = pii.find(docs, pii.fit(docs), into)
    spans = F.col(f"{into}.all")
    same = F.size(spans) == 0
    out = found.withColumn("text", F.when(same, F.col("text")).otherwise(pii.redact(F.col("text"), spans)))
    return out.select(*counted(docs, same))


def counted(docs: DataFrame, same) -> list:
    """The columns of ``docs``; n_chars follows a text that has changed."""
    new = F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return [new.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("jaccard_dedup", jaccard_dedup), ("pii_redaction", redact), ("packing", pack)]

#: SQL can't express the classifier, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
