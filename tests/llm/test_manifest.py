"""Merkle manifests against trees built in memory."""

import hashlib
import zlib

from pyspark.sql import functions as F

from relsight.llm import manifest, queries

SF = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """The root of digests, and each one's proof: (index among its parent's children, digests of the others), from below."""
    proofs, under, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, holds = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for j in range(len(run)):
                for i in under[at + j]:
                    proofs[i].append((j, run[:j] + run[j + 1 :]))
            up.append(h(*run))
            holds.append([i for j in range(len(run)) for i in under[at + j]])
        level, under = up, holds
    return level[0], proofs


def expected(rows):
    """What the query returns for (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for x, own in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            proof, r = own + above[at], x[3]
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            now = leaf(r, text)
            for j, others in proof:
                now = h(*others[:j], now, *others[j:])
            out.append((r[0], x[2], trees[s][0], root, h(*[d for _, others in proof for d in others]), now, now == root))
    return sorted(out, key=str)


def test_query_against_trees_in_memory(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r) for r in queries.op13_manifest(spark, SF).collect()), key=str)
    assert got == expected(rows) and 0 < sum(r[-1] for r in got) < len(got)


def test_edges(spark, tmp_path):
    rows = [(i, f"t{i}\nx", "en", "big", i) for i in range(0, 4000, 2)] + [(i, "same", None, None, None) for i in range(5)]
    rows += [(7, "b", "en", "é", 1), (7, "b", "en", "é", 1), (7, "a", "en", "é", 1), (None, None, None, "é", None), (-3, "", "", "", 0), (9, "line\n" * 40_000, "de", "z", 200_000)]
    rows += [(10_000 + i, f"{i}\n", "en", f"s{i % 9}", i) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaf int, root int, g int"
    for name, some in (("all", rows), ("one", rows[:1]), ("two", rows[:1] + rows[-1:]), ("none", [])):
        spark.createDataFrame([(*r, 1, 2, 3) for r in some], schema).repartition(7, "text").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted((tuple(r) for r in queries.op13_manifest(spark, f"{tmp_path}/{name}").collect()), key=str)
        assert got == (expected(some) if some else [])


def test_full_tasks_pass_on_what_waits(spark, monkeypatch):
    """Leaves in any order, in many tasks: parents that no task can fill are dealt again."""
    n = 5000
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    leaves = spark.createDataFrame([("g", n, i, digests[i]) for i in range(n)], "g string, n long, pos long, digest binary").repartition(9, F.xxhash64("pos"))
    links = manifest.links_of(leaves)
    top = links.orderBy(F.desc("level")).first()
    assert links.count() == sum(manifest.nodes_at(n, i) for i in range(1, manifest.height(n) + 1)) and top.digest.hex() == tree([d.hex() for d in digests])[0]
