import random

import numpy as np
import pyarrow as pa
import xxhash

from relsight.llm import arrays, passages


def found(spark, texts):
    rows = spark.createDataFrame([(i, t if t is None else " ".join(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    return sorted((r.doc_id, r.start, r.end, r.source_id, r.source_start, r.source_end) for r in passages.passages(rows).collect())


def word(n):
    return [f"v{random.randrange(10**6)}" for _ in range(n)]


def test_passage_with_an_insertion_after_a_long_one(spark):
    random.seed(5)
    long, p = word(1000), word(60)
    got = found(spark, [long + word(100) + p + word(20), long + word(100) + p[:30] + ["x"] + p[30:] + word(20)])
    assert got == [(2, 0, 1000, 1, 0, 1000), (2, 1100, 1161, 1, 1100, 1160)]


def test_block_ten_times_in_a_row(spark):
    random.seed(6)
    got = found(spark, [word(60) * 10])
    assert {w for _, start, end, *_ in got for w in range(start, end)} == set(range(60, 600))
    assert all(end - start >= 50 and source_end <= start for _, start, end, _, _, source_end in got)


def test_long_passage_whose_tail_an_earlier_document_holds(spark):
    random.seed(7)
    p = word(6000)
    got = found(spark, [word(30) + p[400:] + word(9), word(11) + p + word(30), word(25) + p + word(40)])
    assert (3, 25, 6025, 2, 11, 6011) in got and (3, 425, 6025, 1, 30, 5630) in got


def test_planted_passages_against_a_search_of_equal_runs(spark):
    """Every run of equal words of 50 or more between two documents is in a passage; documents without one have none."""
    random.seed(8)
    texts = [word(random.randrange(5, 300)) for _ in range(40)]
    for k in range(12):
        p = word(random.randrange(50, 200))
        for i in random.sample(range(40), 2):
            at = random.randrange(len(texts[i]) + 1)
            texts[i][at:at] = p if random.random() < 0.5 else [w.upper() for w in p]
    texts += [None, [], ["one"], texts[3]]
    got = found(spark, texts)
    low = [[w.lower() for w in t or []] for t in texts]
    grams = {}
    for d, t in enumerate(low, 1):
        for i in range(len(t) - 49):
            grams.setdefault(tuple(t[i : i + 50]), []).append((d, i))
    need = {d: set() for d in range(1, len(texts) + 1)}
    for places in grams.values():
        for d, i in sorted(places)[1:]:
            need[d] |= set(range(i, i + 50))
    have = {d: {w for x in got if x[0] == d for w in range(x[1], x[2])} for d in need}
    assert any(need.values()) and all(need[d] <= have[d] for d in need)
    assert all(need[d] or not have[d] for d in need)


def test_one_passage_in_very_many_documents(spark):
    random.seed(9)
    p = word(55)
    got = found(spark, [word(5) + p + word(5) for _ in range(600)])
    assert len(got) == 599 and all(x[1:] == (5, 60, 1, 5, 60) for x in got)


def test_bounds_do_not_depend_on_the_words_given(spark, monkeypatch):
    """Noisy copies, whose extensions stay near their best score for long, and a document that repeats itself."""
    random.seed(11)
    p = word(900)
    texts = [word(40) + p + word(30)]
    for every in (3, 4, 9, 30):
        noisy = [w if random.randrange(every) else "x" for w in p]
        texts.append(word(20) + noisy[:300] + p[300:360] + noisy[360:] + word(50))
    texts.append((word(5) + p[:80]) * 6)
    whole = found(spark, texts)
    assert whole
    for margin in (8, 50):
        monkeypatch.setattr(passages, "MARGIN", margin)
        assert found(spark, texts) == whole


def edited(p, kind):
    out = []
    for i, w in enumerate(p):
        if kind == "drop and insert":
            out += ([] if random.random() < 0.05 else [w]) + (word(1) if random.random() < 0.05 else [])
        else:
            out.append(*word(1)) if (i % kind == kind - 1 if isinstance(kind, int) else random.random() < float(kind)) else out.append(w)
    return out


def test_edited_passages_are_found(spark):
    """Of passages of 60 to 160 words in each class of edits, at least 0.9 are found to 0.8 of their words."""
    random.seed(13)
    texts, planted = [], []
    for kind in (8, 10, 12, "0.1", "0.12", "drop and insert"):
        for _ in range(60):
            p = word(random.randrange(60, 161))
            q = edited(p, kind)
            lead = random.randrange(30, 200)
            texts += [word(random.randrange(200)) + p + word(random.randrange(200)), word(lead) + q + word(random.randrange(200))]
            planted.append((kind, len(texts), lead, lead + len(q)))
    got = found(spark, texts)
    share = {}
    for kind, d, lo, hi in planted:
        have = {w for x in got if x[0] == d and x[3] == d - 1 for w in range(max(x[1], lo), min(x[2], hi))}
        share.setdefault(kind, []).append(len(have) >= 0.8 * (hi - lo))
    assert all(sum(v) >= 0.9 * len(v) for v in share.values()), {k: sum(v) / len(v) for k, v in share.items()}
    # Nothing was planted between other documents.
    assert all(x[0] - x[3] == 1 and x[0] % 2 == 0 for x in got)


def test_passage_whose_halves_stand_in_other_documents(spark):
    random.seed(14)
    a, b = word(30), word(30)
    texts = [word(20) + a + word(20), word(20) + b + word(20), word(10) + a + b + word(10), word(10) + a + word(5), word(7) + a + b + word(3)]
    texts.append(word(4) + a + word(40) + b + word(9))
    got = found(spark, texts)
    assert got == [(5, 7, 67, 3, 10, 70)]


def test_seeds_travel_once(spark):
    """Of texts without repeats, fewer rows are shuffled than one and a half times their seeds."""
    random.seed(15)
    texts = [" ".join(word(800)) for _ in range(60)]
    words, at = arrays.hash_words(pa.array(texts))
    seeds = len(passages.minimizers(words, at)[0])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shuffled():
        sc, jvm = spark.sparkContext, spark.sparkContext._jvm
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert passages.passages(rows).count() == 0
    assert seeds > 8000 and seeds <= shuffled() - before < 1.5 * seeds


def test_first_places_against_a_dictionary(monkeypatch):
    """Crowded hashes and others, over slices and batches that cut them: each place is told the first one, by either way."""
    monkeypatch.setattr(passages, "FEW", 3)
    rng = np.random.default_rng(16)
    h, doc, pos = rng.zipf(1.3, 3000) % 500 - 250, rng.integers(0, 40, 3000), rng.integers(0, 10**6, 3000)
    many = np.concatenate([passages.crowded(h[i : i + 500], doc[i : i + 500], pos[i : i + 500]) for i in range(0, 3000, 500)])
    first = {}
    for x in sorted(zip(h.tolist(), doc.tolist(), pos.tolist(), strict=True)):
        first.setdefault(x[0], x[1:])
    sent = np.flatnonzero(many < 2)
    sent = sent[np.argsort(h[sent], kind="stable")]
    batches = [pa.record_batch([pa.array(c[sent[i : i + 7]]) for c in (h, doc, pos, many)], names=["h", "doc_id", "pos", "many"]) for i in range(0, len(sent), 7)]
    out = [r for b in passages.first_places(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["a"], r["pa"], r["b"], r["pb"]) for r in out if r["b"] is not None) == sorted((*first[k], d, p) for k, d, p in zip(h[sent].tolist(), doc[sent].tolist(), pos[sent].tolist(), strict=True) if (d, p) != first[k])
    assert {(r["h"], r["a"], r["pa"]) for r in out if r["b"] is None} == {(k, *first[k]) for k in h[many == 2].tolist()}
    assert (many == 2).any() and all(((h == k) & (many < 2)).sum() <= 18 for k in set(h.tolist()))


def test_passage_that_crowds_some_slices(spark):
    """A passage of most documents, over slices of one partition each: all name its earliest document."""
    random.seed(17)
    p = word(60)
    texts = [(i, " ".join(word(5) + (p if i % 4 else []) + word(5))) for i in range(200)]
    random.shuffle(texts)
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.start, r.end, r.source_id, r.source_start, r.source_end) for r in passages.passages(rows).collect())
    assert got == [(i, 5, 65, 1, 5, 65) for i in range(2, 200) if i % 4]


def test_words_are_hashed_together(monkeypatch):
    """The hashes are the library's, which is asked for words of 32 bytes or more only."""
    random.seed(18)
    words = [bytes(random.randrange(256) for _ in range(n % 70)) for n in range(3000)]
    want = [xxhash.xxh64_intdigest(w) for w in words]
    asked, library = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(arrays.xxhash, "xxh64_intdigest", lambda w: asked.append(w) or library(w))
    assert arrays.word_hashes(pa.array(words, pa.large_binary())).tolist() == want
    assert arrays.word_hashes(pa.array(words, pa.large_binary())[40:90]).tolist() == want[40:90]
    assert arrays.word_hashes(pa.array([], pa.large_binary())).tolist() == []
    assert all(len(w) >= 32 for w in asked)
    arrays.hash_words(pa.array(["one two three"]))
    assert all(len(w) >= 32 for w in asked)


def test_clashing_names_and_empty_table(spark):
    random.seed(10)
    text = " ".join(word(60))
    rows = spark.createDataFrame([(1, text, 1, 2), (2, text, 1, 2), (None, text, 1, 2)], "doc_id long, text string, key int, h int")
    assert [(r.doc_id, r.start, r.end, r.source_id) for r in passages.passages(rows).collect()] == [(2, 0, 60, 1)]
    assert passages.passages(rows.where("false")).count() == 0
