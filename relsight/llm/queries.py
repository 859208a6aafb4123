"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the texts again from the ids."""
    import public_tokenizers

    from relsight.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path)
    kept = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(kept, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted with a loss mask, digested from what is read back."""
    from relsight.llm.chat import format_chat, read_back

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    back = read_back(format_chat(rows.unionByName(extra)))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies: the row with the largest doc_id of equal texts stays."""
    from relsight.llm.exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    from relsight.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label."""
    from relsight.llm.metric import metric_links

    return metric_links(table(spark, sf_dir, "embeddings"), 0.93)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    from relsight.llm.quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out())
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 5-word shingles at a Jaccard similarity of 0.8."""
    from relsight.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: the base rules and what the boosted candidates add."""
    from relsight.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    # The lambda has one parameter: a second one would be the element's position.
    number = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.named(F.col("pii.base")), 256).alias("base_sha256"), pii.named(F.col("pii.all")).alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that earlier documents have, deleted from later ones after alignment."""
    from relsight.llm.lines import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_lines", F.size("dedup.removed").alias("n_removed"), "dedup.removed", "dedup.partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that an earlier document or place has, edits allowed."""
    from relsight.llm.passages import passages

    return passages(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, through a fresh cache of digests."""
    import public_tokenizers

    from relsight.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of rebuilt conversations."""
    from relsight.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots and proofs of every document, and whether the document, its line breaks deleted for some, still gives the root."""
    from relsight.llm.manifest import leaf_digest, manifest, verified

    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaf = leaf_digest(*fields, text)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    other = F.when(tampered, leaf_digest(*fields, F.translate(text, "\n", "")))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("g"), F.col("doc_id").alias("by"), leaf.alias("digest"), F.struct("doc_id", leaf.alias("leaf"), other.alias("other")).alias("row"))
    proved, _, root = manifest(rows)
    out = verified(proved, F.coalesce("row.other", "row.leaf"))
    text_of = lambda c: F.lower(F.hex(c))
    root = F.lit(root.hex() if root else None).cast("string")
    return out.select("row.doc_id", text_of("row.leaf").alias("leaf"), text_of("root").alias("subroot"), root.alias("root"), "proof_sha256", text_of("folded").alias("folded_root"), (text_of("folded") == root).alias("verified"))


QUERIES = {"op1_metric_join": op1_metric_join, "op2_bpe": op2_bpe, "op3_chat": op3_chat, "op4_exact_dedup": op4_exact_dedup, "op5_quality": op5_quality, "op6_jaccard_join": op6_jaccard_join, "op7_pii": op7_pii, "op8_packing": op8_packing, "op9_line_dedup": op9_line_dedup, "op10_passages": op10_passages, "op11_token_counts": op11_token_counts, "op12_prefix_trie": op12_prefix_trie, "op13_manifest": op13_manifest}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
}
