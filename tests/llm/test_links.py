"""Operators on pairs against comparisons of all pairs."""

import random

import numpy as np

from relsight.llm import exact, jaccard, metric, queries

SF = "/root/testdata/sf0.01"


def reachable(nodes, links):
    """The smallest node that each one reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard_of_all(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a is not None and b is not None and s and t and a != b and 100 * len(s & t) >= 80 * len(s | t)]
    root = reachable({d for d, _ in rows if d is not None}, links)
    return sorted(((d, len(s), root.get(d)) for d, s in sets), key=str), len(links)


def test_jaccard_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, n = jaccard_of_all(rows)
    assert n and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, SF).collect()), key=str) == want


def test_jaccard_edges(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (3, ""), (4, None), (5, "A b"), (6, "a  b"), (7, " ".join(base[:60])), (8, " \t\n"), (None, "a b"), (9, "é Ä b"), (9, "a b")]
    for i in range(10, 150):  # near copies of one text in one large group, and of boilerplate with some words of their own
        t = list(base) if i < 100 else [f"b{j}" for j in range(40)] + [f"o{i}_{j}" for j in range(random.randrange(20))]
        for _ in range(random.randrange(4)):
            t[random.randrange(len(t))] = f"x{random.randrange(9)}"
        rows.append((i, " ".join(t)))
    rows += [(200, " ".join(base) + " " + "tail " * 50_000), (201, " ".join(base[:50])), (202, " ".join(["q", *base[1:50]])), (201, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    want, n = jaccard_of_all(rows)
    assert n and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, share=2).collect()), key=str) == want
    assert jaccard.jaccard_join(df.where("false")).count() == 0


def test_jaccard_boilerplate_makes_no_large_cluster(spark, monkeypatch):
    """Documents that share more than half of their words and link with nothing aren't compared all with all."""
    random.seed(12)
    shared = [f"b{j}" for j in range(40)]
    rows = [(i, " ".join(shared + [f"o{i}_{j}" for j in range(25)])) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(20)]
    clusters = []
    real = jaccard.written

    def spied(df, name):
        out = real(df, name)
        if name == "member":
            clusters.extend(r[0] for r in out.groupBy("cluster").count().select("count").collect())
        return out

    monkeypatch.setattr(jaccard, "written", spied)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - 2000 if d >= 2000 else d for d, _ in rows}
    assert max(clusters) <= 8


def pair_rows(monkeypatch):
    """Fills with the numbers of rows of each kind that the table of pairs has."""
    kinds = {}
    real = jaccard.written

    def spied(df, name):
        out = real(df, name)
        if name == "pairs":
            kinds.update({r[0]: r[1] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(jaccard, "written", spied)
    return kinds


def test_jaccard_copies_make_no_pairs(spark, monkeypatch):
    """Copies in other tasks meet as one document, so pairs don't grow with the square of their number."""
    kinds = pair_rows(monkeypatch)
    rows = [(100 * c + i, " ".join(f"t{i}_{j}" for j in range(60))) for c in range(40) for i in range(20)]
    rows += [(9000 + i, rows[i][1] + " tail") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    for share in (1000, 1):  # copies make no n-gram frequent either
        kinds.clear()
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, share=share).collect()}
        assert got == {d: d % 100 for d, _ in rows}
        assert kinds.get(0, 0) + kinds.get(4, 0) <= 5 * 13 and not kinds.get(1) and not kinds.get(2)


def test_jaccard_near_copies_pair_once(spark, monkeypatch):
    """Near copies with one first n-gram are paired in one column, not in each that they share."""
    kinds = pair_rows(monkeypatch)
    rows = [(i, " ".join([f"w{j}" for j in range(300)] + [f"end{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    assert {r.component_id for r in jaccard.jaccard_join(df, share=1000).collect()} == {0}
    assert 0 < kinds.get(0, 0) + kinds.get(4, 0) <= 40 * 39 // 2 * 3


def test_jaccard_with_colliding_numbers(spark, monkeypatch):
    """Sets that get one number by chance are still compared apart, and with each other."""
    random.seed(16)
    rows = []
    for i in range(150):
        t = [f"w{i % 30}_{j}" for j in range(60)]
        for _ in range(random.randrange(5)):
            t[random.randrange(len(t))] = f"x{random.randrange(9)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 150, 9)]
    real = jaccard.key_of
    for most in (1, 40, 7 << jaccard.OWN):
        monkeypatch.setattr(jaccard, "key_of", lambda s, head, most=most: (int.from_bytes(real(s, head)[8:], "big") % most).to_bytes(8, "big") + real(s, head)[8:])
        monkeypatch.setattr(jaccard, "MOST_BITS", 64)
        want, n = jaccard_of_all(rows)
        got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), share=2).collect()
        assert n and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def links_of_all(rows, least=0.93):
    good = [(i, np.array(e, float), label) for i, e, label in rows if label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    n = {i: 0 for i, _, _ in rows}
    links = []
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root = reachable(set(n), links)
    return sorted((i, n[i], root[i], root[i] == i) for i, _, _ in rows), len(links)


def test_metric_query_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, _ = links_of_all(rows)
    assert sorted(map(tuple, queries.op1_metric_join(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect())) == want


def test_metric_planted_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        if i % 3 and rows:
            j = rng.integers(len(rows))
            x = np.array(rows[j][1]) * rng.choice([1, 1, 5]) + rng.normal(0, rng.choice([0, 0.02, 0.06]), 16)
            rows.append((i, x.astype(np.float32).tolist(), rows[j][2]))
        else:
            rows.append((i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), int(rng.integers(3))))
    edges = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], rows[0][1][:8], rows[0][1]]
    rows += [(1000 + k, e, rows[0][2]) for k, e in enumerate(edges)] + [(2000, rows[0][1], None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, cell int")
    want, n = links_of_all(rows)
    assert n > 100
    for cell, tile in ((1024, 2048), (16, 8)):
        got = metric.metric_links(df, cell=cell, tile=tile).collect()
        assert sorted(map(tuple, (r[:4] for r in got))) == want
    assert metric.metric_links(df.where("false")).count() == 0


def test_exact_dedup_with_colliding_keys(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "b"), (6, "c"), (7, "x" * 500_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    out = exact.exact_dedup(df, key_of=lambda t: t.isNull().cast("long"), bucket_bytes=1, owner_bytes=1)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()}
    assert got == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 2, True), (None, 2, 2, False), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True)}
    assert exact.exact_dedup(df.where("false")).count() == 0


def test_exact_dedup_with_a_deep_directory(spark):
    rows = [(i, f"text {i % 700}" if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, found = exact.build_index(df, bucket_bytes=40, owner_bytes=400)
    assert found.depth > exact.BITS and len(found.slots) == 1 << found.depth and len(set(found.local)) > 1
    for bucket, depth in enumerate(found.local):
        assert (found.slots == bucket).sum() == 1 << (found.depth - depth)
    assert max(found.size) <= 40 and index.where("key is null").count() == 0
    best, size = {}, {}
    for i, t in rows:
        best[t], size[t] = max(i, best.get(t, i)), size.get(t, 0) + 1
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(df, bucket_bytes=40, owner_bytes=400).collect()}
    assert got == {(i, best[t], size[t], best[t] == i) for i, t in rows}
