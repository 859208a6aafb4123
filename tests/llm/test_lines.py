import hashlib
import random

from relsight.llm import lines

RARE = lines.RARE


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def run(spark, rows):
    return {r.doc_id: (r.dedup.removed, r.dedup.partners, r.text) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_common_is_longest():
    random.seed(3)
    for _ in range(500):
        a, b = ([random.randrange(4) for _ in range(random.randrange(40))] for _ in range(2))
        pairs = lines.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == length(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_patience_without_unique_lines():
    # 7 is long and stands twice on each side; more short lines would align without it.
    a, b = [1, 7, 0, 0, 0, 7, 2], [3, 0, 0, 0, 7, 5, 7, 4]
    assert {j for _, j, n in lines.patience(a, b, [x == 7 for x in b]) for j in range(j, j + n)} >= {4, 6}


def test_line_that_each_document_holds_twice(spark):
    hot = "this licence line is long enough"
    rows = [(d, "\n".join([f"first {d}", hot, f"second {d}", hot, f"third {d}"])) for d in (1, 2, 3)]
    got = run(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {1: [], 2: [1, 3], 3: [1, 3]}


def test_later_documents_meet(spark):
    a, b = "line a of five words", "line b of five words"
    got = run(spark, [(1, f"{a}\n{b}"), (2, f"{b}\n{a}\nzz"), (3, f"{b}\n{a}\nyy")])
    assert got[3][2] == "yy" and 2 in got[3][1]


def brute(rows):
    """Every pair of different texts that share a long line is aligned."""
    key = lambda t: hashlib.md5((t or "").encode()).digest()
    first = {}
    for d, t in rows:
        first[t or ""] = min(first.get(t or "", d), d)
    texts = sorted((d, key(t), t) for t, d in first.items())
    long = lambda x: len(x.split()) >= lines.MIN_WORDS
    out = {}
    for d, t in rows:
        t = t or ""
        mine = t.split("\n")
        if d != first[t]:
            out[d] = list(range(len(mine))) if any(map(long, mine)) else []
            continue
        gone = set()
        for e, k, u in texts:
            if (e, k) < (d, key(t)) and {x for x in u.split("\n") if long(x)} & set(mine):
                for _, j, n in lines.patience([hash(x) for x in u.split("\n")], [hash(x) for x in mine], [long(x) for x in mine]):
                    if any(long(x) for x in mine[j : j + n]):
                        gone |= set(range(j, j + n))
        out[d] = sorted(gone)
    return out


def test_against_all_pairs(spark):
    random.seed(9)
    pool = [f"this is the long line {i}" for i in range(40)] + [f"s{i}" for i in range(5)] + [""]
    rows = [(i, "\n".join(random.choice(pool[max(0, i // 4 * 2 - 4) :] if random.random() < 0.1 else pool[i // 4 * 2 : i // 4 * 2 + 4] + pool[40:]) for _ in range(random.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1])]
    assert_like_brute(spark, rows)


def assert_like_brute(spark, rows):
    """A long line of a document loses a copy exactly where brute force deletes one; nothing goes that brute force keeps.

    Where all lines are rare, the deleted numbers are equal.
    """
    held = {}
    for _, t in rows:
        for x in set((t or "").split("\n")):
            if len(x.split()) >= 5:
                held.setdefault(x, set()).add(t)
    assert max(len(v) for v in held.values()) > 2
    got, want = {k: v[0] for k, v in run(spark, rows).items()}, brute(rows)
    text = {d: (t or "").split("\n") for d, t in rows}
    goes = lambda found: {d: {text[d][k] for k in v if len(text[d][k].split()) >= 5} for d, v in found.items()}
    assert goes(got) == goes(want)
    assert all(set(got[d]) <= set(want[d]) for d in want)
    if all(len(v) <= RARE for v in held.values()):
        assert got == want


def test_frequent_lines_in_all_orders(spark):
    random.seed(4)
    pool = [f"this is the frequent line {i}" for i in range(7)]
    rows = [(i, "\n".join([*random.sample(pool, random.randrange(2, 7)), f"own {i}"])) for i in range(90)]
    assert_like_brute(spark, rows)


def test_order_that_one_far_holder_has(spark):
    a, b = "line a of five words", "line b of five words"
    rows = [(i, f"{a}\n{b}\nown {i}") for i in range(200)] + [(77_000, f"{b}\n{a}\nzz")]
    rows += [(100_000 + i, f"{a}\n{b}\nown {i} too") for i in range(60)] + [(200_000, f"{b}\n{a}\nyy")]
    got = run(spark, rows)
    assert got[200_000][2] == "yy" and 77_000 in got[200_000][1] and len(got[77_000][0]) == 1


def test_the_order_of_an_earlier_text_beyond_rare(spark):
    a, b = "line a of five words", "line b of five words"
    rows = [(i, f"{a}\n{b}\n{i}") for i in (*range(1, 11), 12)] + [(11, f"{b}\n{a}\nzz"), (13, f"{b}\n{a}\nyy")]
    assert run(spark, rows)[13][2] == "yy"


def test_frequent_line_goes_everywhere(spark):
    hot = "the same footer of every single document"
    rows = [(i, f"own {i}\n{hot}\n{i} too") for i in range(500)]
    got = run(spark, rows)
    assert got[0][0] == [] and all(got[i][0] == [1] for i in range(1, 500))


def test_names_clash_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b c d e", 7, 8, 9), (2, "a b c d e", 7, 8, 9)], "doc_id long, text string, first_id int, gone int, dedup int")
    got = {r.doc_id: r for r in lines.line_dedup(rows, into="other").collect()}
    assert (got[2].first_id, got[2].gone, got[2].dedup, got[2].text, got[2].other.removed) == (7, 8, 9, "", [0])
    assert lines.line_dedup(rows.where("false")).count() == 0


def test_long_text_and_null_ids(spark):
    long = "\n".join(f"line number {i} of many" for i in range(20_000))
    got = run(spark, [(1, long), (2, "x\n" + long), (None, "tail of a null document\ny")])
    assert got[2][2] == "x" and got[None][2] == "tail of a null document\ny"
