"""The prefix trie against one built in memory."""

import hashlib
import zlib

from relsight.llm import queries, trie

SF = "/root/testdata/sf0.01"


def expected(rows):
    """All nodes of the trie of rebuilt (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    skip = lambda c: zlib.crc32(str(c).encode()) % 9
    base = lambda c: c - (abs(c) % 5 * (1 if c > 0 else -1))
    new = {c: convs.get(base(c), [])[: skip(c)] + v[skip(c) :] for c, v in convs.items()}
    if not new:
        return []
    members, ends = {}, {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        parent = min(members[node[:-1]]) if node else None
        ended = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], ended))
    return sorted(out)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_query_against_a_trie_in_memory(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert got(queries.op12_prefix_trie(spark, SF)) == want and max(r[4] for r in want) > 1


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "IDS", 4)
    said = lambda c, n, k: [(c, i, "user", f"t{i % k}" if i < 9 else f"c{c}") for i in range(n)]
    rows = [x for c in range(0, 60) for x in said(c, 12 if c % 5 == 0 else c % 11, 1 + c % 2)]
    rows += [(100 + c, i, "a", f"deep{i}") for c in range(25) for i in range(c)]  # each one turn longer than the last: chains upon chains
    rows += [(200, i, "a", f"long {i}" * (i % 7)) for i in range(60)] + [(201, i, "a", f"long {i}" * (i % 7)) for i in range(55)]
    rows += [(300, None, None, None), (300, 1, "é", "é" * 20_000), (300, 1, "a", "z"), (300, 1, "a", "z"), (None, 0, "a", "b"), (-3, 0, "a", "b"), (-5, 0, "a", "b"), (-7, 2, "a", "c"), (500_001, 0, None, "x")]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "conv_id long, turn int, role string, text string, owner int, d int, p string").repartition(5)
    assert got(trie.prefix_trie(df)) == expected(rows)
    assert trie.prefix_trie(df.where("false")).count() == 0 and trie.prefix_trie(df.where("conv_id is null")).count() == 0
    one = [r for r in rows if r[0] == 500_001]
    assert got(trie.prefix_trie(df.where("conv_id = 500001"))) == expected(one)
