"""Quality classifier: averaged hashed word and character n-gram vectors, softmax output.

A document's features are its words and the character n-grams of each word
between marks, all hashed to BUCKETS rows, the form of each word n-gram that
repeats a word (three rows: the word before, the one before that, both), and
one constant feature. Their vectors are averaged; two softmax outputs are trained with stochastic
gradient descent in numpy on at most ``sample`` labelled rows - the ones with
the smallest hash of their id, at every size. Scoring covers whole texts.

Defined cases: null and empty texts have the constant feature alone; null or
other labels than 0 and 1 aren't learned from; a document with several labels
is learned with each; no labels give the score 0.5; repeated rows are scored
each; a null doc_id isn't held out and stays null; an empty table gives no
rows; other columns are carried and never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsight.llm.arrays import mix, slices, word_table
from relsight.llm.shared import small_batches

BUCKETS = 1 << 17
GRAMS = (3, 4)
#: Labelled rows that training reads at most.
SAMPLE = 6000
#: Text whose features are made at once.
SLICE = 1 << 19


@dataclass
class Model:
    """Vectors of the buckets, the constant feature and the forms of repeats, and softmax weights."""

    vectors: np.ndarray
    weights: np.ndarray

    def logits(self) -> np.ndarray:
        """What each feature adds to the log odds of label 1, before averaging."""
        return self.vectors.astype(np.float64) @ (self.weights[1] - self.weights[0]).astype(np.float64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of all features of the words."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    cps = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, count=len(words)))
    whole = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, count=len(words))
    owners, buckets = [np.arange(len(words))], [whole % np.uint64(BUCKETS)]
    for n in GRAMS:
        if len(cps) < n:
            continue
        h = np.full(len(cps) - n + 1, np.uint64(n))
        for j in range(n):
            h = mix(h * np.uint64(0x100000001B3) + cps[j : len(cps) - n + 1 + j])
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        buckets.append((h % np.uint64(BUCKETS))[inside])
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def repeats(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word: 1 if it is the word before, 2 if the one before that, 3 if both, else 0."""
    place = np.arange(len(codes)) - np.repeat(rows[:-1], np.diff(rows))
    out = np.zeros(len(codes), np.int64)
    for back, value in ((1, 1), (2, 2)):
        out[back:] += value * ((codes[back:] == codes[:-back]) & (place[back:] >= back))
    return out


def document_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each document and their shares, in four bytes each."""
    table, rows = word_table(column, lower=False)
    codes = table.indices.to_numpy(zero_copy_only=False)
    owner, bucket = word_features(table.dictionary.to_pylist())
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    at = np.searchsorted(owner, np.arange(len(table.dictionary) + 1))
    again = repeats(codes, rows)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        used, times = np.unique(codes[a:b], return_counts=True)
        parts = [bucket[at[w] : at[w + 1]] for w in used.tolist()]
        counts = [np.full(len(p), t) for p, t in zip(parts, times.tolist(), strict=True)]
        forms = np.bincount(again[a:b], minlength=4)
        forms[0] = 1
        parts, counts = [*parts, BUCKETS + np.flatnonzero(forms)], [*counts, forms[forms > 0]]
        found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))
        out.append((found.astype(np.int32), (total / total.sum()).astype(np.float32)))
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, epochs: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 4, dim)).astype(np.float32), np.zeros((2, dim), np.float32))
    if not len(labels):
        return model
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            found, share = features[i]
            hidden = share @ model.vectors[found]
            z = model.weights @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = p @ model.weights
            model.weights -= lr * np.outer(p, hidden)
            model.vectors[found] -= lr * np.outer(share, back)
            step += 1
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """Train on the labelled rows for which ``learn`` (a condition on doc_id) holds."""
    chosen = labels.where(learn & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def trained(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        features = [x for batch in slices(iter(table.to_batches()), "text", SLICE) for x in document_features(batch.column("text"))]
        model = train(features, table["label"].to_numpy(), dim, epochs, rate, seed)
        return pa.table({"vectors": [model.vectors.tobytes()], "weights": [model.weights.tobytes()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(trained, "vectors binary, weights binary").first()
    if found is None:
        return train([], np.zeros(0, np.int64), dim, epochs, rate, seed)
    return Model(np.frombuffer(found.vectors, np.float32).reshape(-1, dim), np.frombuffer(found.weights, np.float32).reshape(2, dim))


def score(docs: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the double ``into`` (in place of a column of that name): how likely label 1 is."""
    small_batches(docs.sparkSession)
    logits = model.logits()
    names = [c for c in docs.columns if c.lower() != into.lower()]
    docs = docs.select(*names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            table, rows = word_table(batch.column("text"), lower=False)
            codes = table.indices.to_numpy(zero_copy_only=False)
            owner, bucket = word_features(table.dictionary.to_pylist())
            value = np.bincount(owner, weights=logits[bucket], minlength=len(table.dictionary))
            count = np.bincount(owner, minlength=len(table.dictionary))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            total = np.bincount(doc, weights=value[codes], minlength=batch.num_rows) if len(codes) else np.zeros(batch.num_rows)
            n = np.bincount(doc, weights=count[codes], minlength=batch.num_rows) if len(codes) else np.zeros(batch.num_rows)
            again = repeats(codes, rows)
            total += np.bincount(doc, weights=np.where(again > 0, logits[BUCKETS + again], 0), minlength=batch.num_rows)
            n += np.bincount(doc, weights=again > 0, minlength=batch.num_rows)
            odds = (total + logits[BUCKETS]) / (n + 1)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-odds)))], names=[*names, into])

    return docs.mapInArrow(scored, docs.select("*", F.lit(0.0).alias(into)).schema)


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
