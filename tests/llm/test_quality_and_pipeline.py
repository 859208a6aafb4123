import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from relsight.llm import quality, queries

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_rows(spark):
    rows = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    score, label = (np.array([getattr(r, c) for r in rows if r.held_out]) for c in ("score", "quality"))
    assert len(label) > 100 and auc(score, label) > 0.99 and ((score >= 0.5) == label).mean() > 0.97


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, "good words here", 7), (2, "zz qq ##", 7), (3, None, 7), (None, "", 7), (3, "twice", 7), (4, "w " * 200_000, 7)], "doc_id long, text string, quality_score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 5), (None, 1)], "doc_id long, quality int")
    model = quality.fit(rows, labels, "quality", F.lit(True), epochs=50)
    got = quality.score(rows, model, "s").collect()
    assert len(got) == 6 and all(r.quality_score == 7 and 0 <= r.s <= 1 for r in got)
    by = {r.text: r.s for r in got}
    assert by["good words here"] > 0.5 > by["zz qq ##"] and by[None] == by[""]
    assert quality.score(rows, model).columns == ["doc_id", "text", "quality_score"]
    none = quality.fit(rows, labels.where("false"), "quality", F.lit(True))
    assert {r.s for r in quality.score(rows, none, "s").collect()} == {0.5}
    assert quality.score(rows.where("false"), model).count() == 0


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, gone int, dedup int, pii int, quality_score int, base int, row int, key int, hot_ int"


def planted(spark, path):
    random.seed(1)
    good, bad = [f"word{i}" for i in range(300)], [f"zq{i}##" for i in range(300)]
    say = lambda words, n: " ".join(random.choice(words) for _ in range(n))
    rows = [(i, say(good if i % 4 else bad, 60)) for i in range(1, 121)]
    texts = dict(rows)
    near = texts[1].split(" ")
    near[-1] = "changed"
    footer = "this footer stands in several of the documents"
    rows += [(200, " ".join(near)), (201, texts[2]), (202, f"{say(good, 60)}\n{footer}"), (203, f"{say(good, 60)}\n{footer}"), (204, say(good, 60) + " mail me@some.org now"), (205, None), (None, say(good, 60)), (206, say(good, 3000)), (207, texts[3]), (207, texts[3])]
    spark.createDataFrame([(d, t, "en", "web", t and len(t), 1, 2, 3, 4, 5, 6, 7, 8) for d, t in rows], EXTRA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline_stage_by_stage(spark, tmp_path):
    """The planted rows and no others change, stage by stage."""
    rows = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bad = {d for d, _ in rows if d and d <= 120 and d % 4 == 0}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            found = out.collect()
            assert all((r.gone, r.dedup, r.pii, r.quality_score, r.base, r.row, r.key, r.hot_) == tuple(range(1, 9)) for r in found)
            assert all(r.n_chars == (r.text and len(r.text)) for r in found)
            seen[name] = sorted(((r.doc_id, r.text) for r in found), key=str)
            docs = spark.createDataFrame(found, docs.schema)
        else:
            packed = out.collect()
    keep = [r for r in rows if r[0] not in bad and r[1] is not None]
    first = [r for r in seen["quality_classifier"] if r[1] is not None]
    assert first == sorted(keep, key=str)
    # Whole copies lose their one line and go; the later footer goes.
    texts = dict(rows)
    lost = [(d, texts[203].split("\n")[0] if d == 203 else t) for d, t in keep if d not in (201, 207)]
    assert [r for r in seen["line_dedup"] if r[1]] == sorted(lost, key=str)
    assert [r for r in seen["jaccard_dedup"] if r[1]] == sorted([r for r in lost if r[0] != 200], key=str)
    clean = [(d, t.replace("me@some.org", "[EMAIL]")) for d, t in lost if d != 200]
    assert [r for r in seen["pii_redaction"] if r[1]] == sorted(clean, key=str)
    assert {r.doc_id for r in packed} == {d for d, _ in seen["pii_redaction"]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_stages_of_an_empty_table(spark, tmp_path):
    planted(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
