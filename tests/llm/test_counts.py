"""Token counts against the libraries, and what the cache saves."""

import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relsight.llm import counts, queries

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", " ", "  ", "▁", "▁▁", "\n", "\t", "é", "日本", "<s>", "</s>", "<0x41>", "the", "\x00", "　", "🙂", "\xa0", "'s", " .", "word", "é"]


def by_library(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return sorted(((d, len((t or "").encode()), n, n > 4096) for d, t in rows for n in [len(model.encode(t or ""))]), key=str)


def test_query_against_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_token_counts(spark, SF).collect()), key=str)
    assert got == by_library(rows) and any(r[-1] for r in got)


def test_edges(spark):
    random.seed(5)
    rows = [(1, None), (2, ""), (3, " "), (4, "▁"), (None, "x"), (5, "x"), (5, "x"), (6, "word " * 60_000), (7, "w" * 100_000), (8, " " * 5000)]
    rows += [(100 + i, "".join(random.choice(PARTS) for _ in range(random.randrange(40)))) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n_tokens int, digest string")
    assert sorted((tuple(r) for r in counts.token_counts(df, MODEL, 4096).collect()), key=str) == by_library(rows)
    assert counts.token_counts(df.where("false"), MODEL, 4096).count() == 0


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    texts = [f"text {i % 40}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cache = str(tmp_path / "cache")
    batches = lambda: sorted(r.n for r in spark.read.parquet(f"{cache}/{counts.version(MODEL)}").groupBy("batch").agg(F.count("*").alias("n")).collect())
    assert counts.token_counts(df.where("doc_id < 30"), MODEL, 2, cache).count() == 30 and batches() == [30]
    got = counts.token_counts(df, MODEL, 2, cache)
    assert batches() == [10, 30] and sorted(map(tuple, got.collect()), key=str) == sorted(((i, n, k, k > 2) for i, n, k, _ in by_library(enumerate(texts))), key=str)
    counts.token_counts(df, MODEL, 2, cache).count()
    assert batches() == [10, 30]
    monkeypatch.setattr(counts, "SENT_BYTES", 0)  # as where the missing keys are too many to be sent
    more = spark.createDataFrame([(1, "new one"), (2, "text 3"), (3, "new one")], "doc_id long, text string")
    assert counts.token_counts(more, MODEL, 2, cache).count() == 3 and batches() == [1, 10, 30]
    # Another tokenizer has keys of its own, and counts of its own library.
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = {r.doc_id: r.n_tokens for r in counts.token_counts(df, path, 2, cache).collect()}
    assert other == dict(enumerate(len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)))
