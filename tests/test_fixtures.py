"""Small inputs with results worked out by hand: profiles, files, validators, property sets and the generator."""

import csv
import lzma
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relsight import __main__ as cli
from relsight.functions import iri
from relsight.operators import interesting, logic, metrics, stats, validate
from relsight.sinks import buckets, reports
from relsight.sources import readers
from relsight.sources.generator import heritage_graph
from relsight.streaming import degrees
from relsight.streaming.counts import predicate_counts, stream_lines

LINES = ["<http://e/s1> <http://e/p> <http://e/o1> .", "<http://e/s1> <http://e/p> <http://e/o1> .", '<http://e/s1> <http://e/q> "hi"@EN .', "<http://e/s2> <http://e/p> <http://e/o2> .", '_:b1 <http://e/q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', '_:b1 <http://e/r> "x" .', "# comment", "garbage", "", "<http://e/s2> <https://e/p> _:b1 ."]
P, Q, R, PS = "<http://e/p>", "<http://e/q>", "<http://e/r>", "<https://e/p>"


@pytest.fixture(scope="module")
def triples(spark):
    return readers.triples(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


def chosen(spark, *names):
    return interesting.aliases(readers.read_predicates(spark.createDataFrame([(x,) for x in names], "value string")))


def rows(path):
    with open(path, newline="") as f:
        return list(csv.reader(f))


def test_files_of_triples(spark, triples, tmp_path):
    text = tmp_path / "in.nt"
    text.write_text("\n".join(LINES) + "\n")
    cli.run(spark, ["rdf", "--input", str(text), "--outdir", str(tmp_path / "out"), "--unique-so", "--duplicate-excess", "--plots"])
    out = lambda name: rows(tmp_path / "out" / f"{name}.csv")
    assert out("1_predicate_distribution")[:3] == [["predicate", "count", "share"], [P, "3", str(3 / 7)], [Q, "2", str(2 / 7)]]
    meta = out("1_meta_entropy_gini")
    assert meta[0] == ["N_triples", "N_predicates", "entropy_bits", "gini"] and meta[1][:2] == ["7", "4"] and float(meta[1][2]) == pytest.approx(1.842371, abs=1e-6)
    basic = {r[0]: r for r in out("2_per_predicate_basic")}
    assert basic["predicate"][-2:] == ["unique_s_o_pairs", "duplicate_excess"] and basic[P][3:7] == ["2", "2", "1.5", "1.5"] and basic[P][-2:] == ["2", "1"] and basic[Q][-2:] == ["2", ""]
    pairs = out("3_predicate_cooccurrence")
    assert pairs[0][8:] == ["conf(A->B)", "conf(B->A)", "lift(A->B)", "lift(B->A)"] and [r[:2] for r in pairs[1:]] == [[P, Q], [P, PS], [Q, R]]
    assert len(out("4_association_rules")) == 4 and [r[0] for r in out("5_per_predicate_graph_metrics")] == ["predicate", P, Q, R, PS]
    assert out("plot_top")[:2] == [["p", "count", "label"], [P, "3", "p"]]
    (tmp_path / "chosen").write_text("e:p\n<http://e/q>\n# no\n")
    (tmp_path / "prefixes").write_text('{"e": "http://e/"}')
    cli.run(spark, ["rdf", "--input", str(text), "--outdir", str(tmp_path / "out"), "--plots", "--plots-curie-labels", "--plots-dpi", "99", "--predicates-file", str(tmp_path / "chosen"), "--prefixes", str(tmp_path / "prefixes"), "--topk", "0"])
    assert out("plot_top")[1] == [P, "3", "e:p"]
    heat = {tuple(r[:2]): r[2:] for r in out("plot_interesting_heatmap")[1:]}
    assert heat == {(P, P): ["3", "e:p", "e:p"], (Q, Q): ["2", "e:q", "e:q"], (P, Q): ["1", "e:p", "e:q"], (Q, P): ["1", "e:q", "e:p"]}
    # Without a top k the graph has the chosen predicates only, and without those it is empty.
    assert [r[0] for r in out("5_per_predicate_graph_metrics")[1:]] == [P, Q, PS, "<https://e/q>"]
    assert reports.profile_rdf(triples, topk=0)["5_per_predicate_graph_metrics"][0].count() == 0
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith(".") and not x.endswith(".crc")]


def test_chosen_predicates(spark, triples):
    (r,) = interesting.summary(triples, chosen(spark, "http://e/p")).collect()
    assert (r["count"], r.unique_subjects, r.unique_objects, r.unique_s_o_pairs, r.duplicate_excess, r.subj_IRI, r.obj_IRI, r.obj_BNODE) == (4, 3, 3, 3, 1, 4, 3, 1)
    assert r.avg_out_degree_p == pytest.approx(4 / 3) and r.std_out_degree_p == pytest.approx(0.471405, abs=1e-6)
    pairs = {(x.p_a, x.p_b): x for x in interesting.cooccurrence(triples, chosen(spark, "http://e/p")).collect()}
    assert set(pairs) == {(P, P), (P, Q)} and pairs[P, P].jaccard == pytest.approx(0.2) and pairs[P, Q].conf_ba == pytest.approx(0.5)
    files = reports.profile_rdf(triples, chosen(spark, "http://e/q", "http://e/none"))
    assert files["8_interesting_predicates_summary"][0].columns == reports.SUMMARY
    assert [tuple(x) for x in files["9_interesting_predicates_datatypes"][0].collect()] == [(Q, "<http://www.w3.org/2001/XMLSchema#integer>", 1, 0.5)]
    assert [tuple(x) for x in files["10_interesting_predicates_langs"][0].collect()] == [(Q, "en", 1, 0.5)]
    assert {r.unique_s_o_pairs for r in files["2_per_predicate_basic"][0].collect()} == {None}
    ranks = {x.predicate: x.deg_centrality for x in files["5_per_predicate_graph_metrics"][0].collect()}
    assert ranks["<http://e/none>"] == 0.0
    report = interesting.match_report(triples, chosen(spark, "http://e/q", "http://e/none"))
    assert [x.display for x in interesting.missing(report).collect()] == ["<http://e/none>"]


def test_graph_metrics(triples):
    got = {r.predicate: r for r in metrics.graph_metrics(stats.predicate_sets(triples)).collect()}
    for p, deg, wd, rank in ((P, 2 / 3, 2, 0.324561), (R, 1 / 3, 1, 0.175439)):
        assert got[p].deg_centrality == pytest.approx(deg) and got[p].weighted_degree == wd and got[p].pagerank == pytest.approx(rank, abs=1e-4)


def test_nodes_without_pairs(spark):
    """A top predicate that the cap drops from every set is a node still."""
    t = spark.createDataFrame([("x", "a", "1"), ("x", "b", "1"), ("y", "a", "1")], "s string, p string, o string")
    got = {r.predicate: tuple(r)[1:] for r in metrics.graph_metrics(stats.predicate_sets(t, 5, 1), metrics.graph_nodes(t, 5)).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.0, 0.0, 0.0)}
    sets = {tuple(r.ps): r.n for r in stats.predicate_sets(t, 1, 5).collect()}
    many = {tuple(r.ps): r.n for r in stats.predicate_sets(t, 0, 5).collect() if r.n}
    assert sets == {("a",): 2} and many == {("a", "b"): 1, ("a",): 1}


def test_many_prefixes(spark):
    prefixes = {f"p{i}": f"http://e/{i}/" for i in range(10_000)} | {"q": "http://e/77/x", "again": "http://e/5/"}
    c = F.col("value")
    df = spark.createDataFrame([("<http://e/77/xy>",), ("<http://e/9999/é>",), ("<http://e/5/>",), ("<http://f/>",), ("p8:z",), ("none:z",)], "value string")
    got = [tuple(r) for r in df.select(iri.to_curie(c, prefixes), iri.canonical(c, prefixes), iri.label(c, prefixes)).collect()]
    assert [r[0] for r in got] == ["q:y", "p9999:é", "p5:", None, None, None] and [r[1] for r in got][4:] == ["<http://e/8/z>", None] and got[3][2] == "f"


def test_graph_metrics_by_joins(spark):
    sp = spark.createDataFrame([(s, p) for s, ps in enumerate(["ab", "bc", "bcd", "e"]) for p in ps], "s int, p string")
    one, many = ({r.predicate: tuple(r[1:]) for r in metrics.graph_metrics(stats.sets_of(sp), rounds=3, small=n).collect()} for n in (1000, 0))
    assert one.keys() == many.keys() and all(one[p] == pytest.approx(many[p]) for p in one)


EDGES = "node_id_start,node_id_end,rel_type\nn1,n2,owner\nn1,n2,owner\nn1,n3,addr\nn2,n3,addr\n n4 , n3 ,owner\n,n3,owner\n"


def test_files_of_edges(spark, tmp_path):
    (tmp_path / "e.csv").write_text(EDGES)
    (tmp_path / "nodes-company.csv").write_text("node_id\nn1\nn2\n")
    (tmp_path / "nodes-person.csv").write_text("node_id,type\nn1,Person\nn3,\n")
    (tmp_path / "nodes-bad.csv").write_text("x\n1\n")
    argv = ["edges", "--edges", str(tmp_path / "e.csv"), "--nodes-glob", str(tmp_path / "nodes-*.csv")]
    with pytest.warns(UserWarning, match="skipped"):
        cli.run(spark, [*argv, "--outdir", str(tmp_path / "out"), "--interesting", "owner, ", "--interesting-scope", "any"])
    out = lambda name, d="out": rows(tmp_path / d / f"{name}.csv")
    assert out("1_predicate_distribution") == [["rel_type", "count", "share"], ["owner", "3", "0.6"], ["addr", "2", "0.4"]]
    assert out("1_meta_entropy_gini")[0] == ["N_edges", "N_rel_types", "entropy_bits", "gini"] and out("1_meta_entropy_gini")[1][0] == "5"
    assert out("2_per_predicate_basic")[1] == ["owner", "3", "0.6", "2", "2", "1.5", "0.5", "1", "2", "1.5", "0.5", "1", "2"]
    assert len(out("3b_predicate_cooccurrence_interesting")) == 2 and len(out("4b_association_rules_interesting")) == 2
    assert out("6_subject_category_counts") == [["rel_type", "subject_category", "count", "share_among_rel"], ["addr", "Person", "1", "0.5"], ["addr", "company", "1", "0.5"], ["owner", "Person", "2", str(2 / 3)]]
    assert out("7_object_category_counts")[1:] == [["addr", "person", "2", "1.0"], ["owner", "company", "2", str(2 / 3)], ["owner", "person", "1", str(1 / 3)]]
    cli.run(spark, ["edges", "--edges", str(tmp_path / "e.csv"), "--outdir", str(tmp_path / "sub"), "--interesting", "owner"])
    assert out("1_meta_entropy_gini", "sub")[1][0] == "3" and len(out("3_predicate_cooccurrence", "sub")) == 1
    with pytest.raises(ValueError, match="no column"):
        readers.read_edges(spark, str(tmp_path / "nodes-bad.csv"))


def test_text_of_every_codec(spark, tmp_path):
    text = "\n".join(LINES) + "\r\nlast \rold mac\n"
    for name, data in (("a.nt.xz", lzma.compress(text.encode()) + lzma.compress(text.encode())), ("b.lzma", lzma.compress(text.encode(), lzma.FORMAT_ALONE)), ("big.xz", lzma.compress(b"<a> <b> <c> .\n" * 500_000))):
        (tmp_path / name).write_bytes(data)
    want = [*LINES, "last ", "old mac"]
    assert [r.value for r in readers.text_lines(spark, str(tmp_path / "a.nt.xz")).collect()] == want * 2
    assert [r.value for r in readers.text_lines(spark, str(tmp_path / "b.lzma")).collect()] == want
    assert readers.read_ntriples(spark, str(tmp_path / "big.xz")).count() == 500_000
    assert readers.parse_interesting(" a, ,b,") == ["a", "b"]


GRAPHS = {"aa": "TTTFFTFFT", "aa aa": "TTTFFTFFF", "ab ba": "FTFTFFFTT", "ab bc": "FFFTTTTTT", "ab bc ac": "FFTTTTTFF", "aa bb ab ba": "TTTFFFFFF", "aa ab": "FFTFFTFFF", "ab bc ca": "FFFTTTFTT"}


def test_validators(spark):
    edges = [(g, x[0], x[1], validate.PROPERTIES) for g in GRAPHS for x in g.split()] + [("tagged", "a", "b", ["SYM"]), ("tagged", "b", "a", []), ("untagged", "a", "b", None)]
    got = {}
    for r in validate.validate_all(spark.createDataFrame(edges, "rel string, src string, dst string, brc array<string>")).collect():
        got.setdefault(r.relation, {})[r.property] = r.holds
    assert {g: "".join("T" if got[g][p] else "F" for p in validate.PROPERTIES) for g in GRAPHS} == {g: "".join(dict(zip(["REF", "SYM", "TRA", "IRF", "ASM", "ANS", "ACC", "ITR", "ANT"], want, strict=True))[p] for p in validate.PROPERTIES) for g, want in GRAPHS.items()}
    assert got["tagged"] == {"SYM": False} and "untagged" not in got


def held(edges, tag):
    return {r.relation: r.holds for r in validate.validate(edges.select("*", F.array(*[F.lit(x) for x in validate.PROPERTIES]).alias("brc")), tag).collect()}


def by_hand(edges):
    """Which types have an open two-hop, a closed one, and a cycle, from (rel, src, dst) rows."""
    want = {}
    for rel in {e[0] for e in edges}:
        own = [e[1:] for e in edges if e[0] == rel]
        have, targets = set(own), {}
        for a, b in own:
            targets.setdefault(a, []).append(b)
        hops = [(a, c) for i, (a, b) in enumerate(own) for j, (x, c) in enumerate(own) if i != j and b == x]
        left = have
        while True:
            less = {(a, b) for a, b in left if any(y == a for _, y in left) and any(x == b for x, _ in left)}
            if less == left:
                break
            left = less
        want[rel] = (any(h not in have for h in hops), any(h in have for h in hops), bool(left))
    return want


@pytest.mark.parametrize("size", [(16, 2_000_000), (1, 0)])
def test_hops_and_cycles_against_all_pairs(spark, monkeypatch, size):
    words, probed = size
    monkeypatch.setattr(validate, "WORDS", words)
    monkeypatch.setattr(validate, "PROBED", probed)
    monkeypatch.setattr(validate, "TARGETS", 4 if words == 1 else 512)
    random.seed(words)
    edges = []
    for g in range(60):
        n, m = random.randrange(2, 9), random.randrange(1, 14)
        edges += [(f"r{g}", random.randrange(n), random.randrange(n)) for _ in range(m)]
    order = [(a, b) for a in range(90) for b in range(a + 1, 90)]
    edges += [("order", *x) for x in order] + [("gap", *x) for x in order if x != (3, 80)] + [("bipartite", a, 100 + b) for a in range(40) for b in range(40)] + [("bipartite", 100, 200)]
    want = by_hand([e for e in edges if e[0] not in ("order", "gap", "bipartite")]) | {"order": (False, True, False), "gap": (True, True, False), "bipartite": (True, False, False)}
    df = spark.createDataFrame(edges, "rel string, src long, dst long")
    tra, ant = held(df, "TRA"), held(df, "ANT")
    assert {g: (not tra[g], not ant[g]) for g in want} == {g: w[:2] for g, w in want.items()}
    if probed:  # cycles don't depend on the sizes of blocks
        itr, acc = held(df, "ITR"), held(df, "ACC")
        assert {g: (itr[g], not acc[g]) for g in want} == {g: (w[0], w[2]) for g, w in want.items()}


def test_long_ladders_and_hubs(spark):
    """Long narrow graphs end in tens of turns, and a hub's two-hops are never made."""
    n = 1000
    rungs = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("x"), "id")
    step = lambda name, last: rungs.select(F.lit(name).alias("rel"), (2 * F.col("id") + F.col("x.a")).alias("src"), (last + F.col("x.b")).alias("dst"))
    ladder = step("ladder", 2 * F.col("id") + 2)
    round_ = step("round", (2 * F.col("id") + 2) % (2 * n))
    chain = spark.range(300).select(F.lit("chain"), "id", F.col("id") + 1)
    ring = spark.range(100).select(F.lit("ring"), "id", (F.col("id") + 1) % 100)
    assert held(ladder.union(round_).union(chain).union(ring), "ACC") == {"ladder": True, "round": False, "chain": True, "ring": False}
    hub = spark.range(100_000).select(F.lit("hub").alias("rel"), "id", F.lit(-1).cast("long")).union(spark.range(100_000).select(F.lit("hub"), F.lit(-1).cast("long"), F.col("id") + 200_000)).toDF("rel", "src", "dst")
    closed = hub.union(spark.createDataFrame([("closed", 1, -1), ("closed", 1, 2), ("closed", -1, 2)], "rel string, src long, dst long"))
    assert held(hub, "TRA") == {"hub": False} and held(closed, "ANT") == {"hub": True, "closed": False}


def test_property_sets(spark):
    sets = {frozenset(r.members): r.closure for r in logic.subsets(spark).collect()}
    assert sum(v is not None for v in sets.values()) == 117
    named = lambda *x: logic.mask(x)
    assert sets[frozenset(["ACC"])] == named("ACC", "ANS", "ASM", "IRF") and sets[frozenset(["TRA", "IRF"])] == named("ACC", "ANS", "ASM", "IRF", "TRA") and sets[frozenset(["SYM", "TRA"])] == named("REF", "SYM", "TRA")
    assert sets[frozenset(["SYM", "ANS"])] is None and sets[frozenset(["SYM", "ANS", "TRA"])] is None and sets[frozenset(["REF", "SYM", "ANS"])] is not None
    sizes = sorted(r.size for r in logic.equivalence_classes(spark).collect())
    assert sizes == sorted([1] * 25 + [2] * 4 + [5] * 2 + [6] * 2 + [8] * 4 + [14, 16, 395])
    text, table = cli.class_lines(spark, False), cli.class_lines(spark, True)
    assert text[0] == "1: Ø" and text[-1] == "40" and table[0] == "1,Ø" and table[-1] == "count,40" and len(table) == 41


def test_generator(spark, tmp_path):
    g = heritage_graph(spark, 20, 15, 25, 12, 1.5, 3, "pl_PL")
    got = {r.p.rsplit("/", 1)[-1].rstrip(">"): r["count"] for r in g.groupBy("p").count().collect()}
    assert got["P55_has_current_location"] == 25 and got["P4_has_time_span"] == 12 and 15 < got["P89_falls_within"] <= 30
    crm = lambda name: g.where(F.col("p").endswith(f"{name}>"))
    apart = crm("P133_is_spatiotemporally_separated_from")
    assert apart.where("s = o").count() == 0 and apart.select("o", "p", "s").exceptAll(apart).count() == 0
    assert g.where(F.col("o").endswith('"@pl')).count() == 72 and heritage_graph(spark, 20, 15, 25, 12, 1.5, 3, "pl_PL").exceptAll(g).count() == 0
    assert heritage_graph(spark, density=-1, seed=1).where("p like '%P9_%'").count() == 0
    with pytest.raises(ValueError, match="no place"):
        heritage_graph(spark, places=0)
    cli.run(spark, ["generate", "--periods", "3", "--output", str(tmp_path / "g.nt")])
    assert readers.count_bad_lines(spark.read.text(str(tmp_path / "g.nt"))).first().bad_lines == 0


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("\n".join(LINES))
    query = predicate_counts(stream_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.predicate: r["count"] for r in spark.table("counted").collect()} == {P: 3, Q: 2, R: 1, PS: 1}


def test_bucketed_tables_stay_where_they_are(spark, tmp_path):
    random.seed(6)
    t = spark.createDataFrame([(random.choice("pq"), "hub" if random.random() < 0.4 else f"n{random.randrange(50)}", f"o{i}") for i in range(2000)], "p string, s string, o string")
    nodes = spark.createDataFrame([(f"n{i % 40}", f"c{i % 7}") for i in range(60)] + [("hub", "h")], "node_id string, category string")
    ends, named = buckets.save_ends(t, "s", "ends_test", str(tmp_path), 4), buckets.save_nodes(nodes, "nodes_test", str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = buckets.category_counts(ends, named, "s")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(s" not in plan and "hashpartitioning(node_id" not in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.category_counts(t, nodes, "s").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ends.where("s = 'hub'").count() == 2
    for name in ("ends_test", "nodes_test"):
        buckets.drop(spark, name, str(tmp_path))


def test_stream_of_degrees(spark, tmp_path):
    """After each batch the totals are those of all rows so far, also where degrees that were the smallest or largest are gone."""
    random.seed(7)
    rows = [(random.choice(["x", "y", "é"]), random.choice("pq"), random.choice(["1", "2", '"', "3"])) for _ in range(60)] + [("once", "r", "1")]
    cuts = [rows[:1], rows[1:20], rows[20:], [("once", "r", "1")]]
    seen = []
    for i, part in enumerate(cuts):
        seen += part
        spark.createDataFrame(part, "s string, p string, o string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = degrees.keep_up(spark.readStream.schema("s string, p string, o string").parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", availableNow=True)
        assert query.awaitTermination(120) and query.exception() is None
        if i != 1:
            want = stats.per_predicate(spark.createDataFrame(seen, "s string, p string, o string"))
            near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
            assert near(degrees.per_predicate(spark, f"{tmp_path}/kept")) == near(want)


def test_edges_are_shuffled_once_for_all_tags(spark, monkeypatch):
    """The tagged edges of a report are a row an edge, not a row a tag, and two directions meet in one aggregation."""
    made, kept = {}, validate.written
    monkeypatch.setattr(validate, "written", lambda df, name, *apart: made.setdefault(name, kept(df, name, *apart)) if name == "tagged" else kept(df, name, *apart))
    monkeypatch.setattr(validate, "drop_written", lambda df: None)
    e = spark.createDataFrame([("r", i, i + 1, validate.PROPERTIES) for i in range(50)] + [("r", 0, 1, ["SYM", "SYM", None]), ("none", 0, 1, None)], "rel string, src long, dst long, brc array<string>")
    got = {(r.relation, r.property): r.holds for r in validate.validate_all(e).collect()}
    assert len(got) == 9 and made["tagged"].count() == 51
    assert made["tagged"].where("src = 0 and rel = 'r'").first()[3:] == (1, 2, 1, 1, 1, 1, 1, 1, 1)
    for tag in ("SYM", "ASM", "ANS"):
        plan = validate._violations(e.selectExpr("rel", "src", "dst", "1L as m"), tag)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    ends = spark.createDataFrame([("half", 1, None), ("both", 1, 2), ("both", 2, 1), ("loop", 3, 3)], "rel string, src long, dst long").withColumn("m", F.lit(1))
    assert [sorted({r.rel for r in validate._violations(ends, tag).collect()}) for tag in ("SYM", "ASM", "ANS")] == [["half"], ["both", "loop"], ["both"]]


def test_state_is_looked_into_by_blocks():
    """Many ends of a key are few calls to the state, and totals are those of all batches."""

    class Kept(dict):
        calls = 0

        def getValue(self, key):
            Kept.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            Kept.calls += 1
            self[key] = value

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        def getMapState(self, *_):
            return Kept()

    state, seen = degrees.Degrees(), []
    state.init(Handle())
    for batch in range(3):
        ends = [f"={(i * i + batch) % 30_000}" for i in range(40_000)]
        seen += ends
        part = pd.DataFrame({"end": ends, "block": [hash(x) % degrees.BLOCKS for x in ends]})
        (got,) = state.handleInputRows(("p", "s", 0), iter([part[:25_000], part[25_000:]]), None)
        want = pd.Series(seen).value_counts()
        assert got.iloc[0][["ends", "rows", "squares", "lo", "hi"]].tolist() == [len(want), len(seen), float((want**2).sum()), want.min(), want.max()]
    assert Kept.calls < 3 * 2 * degrees.BLOCKS + 3 * 200


def test_histogram_bins(spark):
    t = spark.range(1, 9).select(F.explode(F.sequence(F.lit(1), F.col("id"))).alias("s"), F.col("id").cast("string").alias("p"))
    assert sum(r.predicates for r in stats.histogram(t, None).collect()) == 8 and {r.bin for r in stats.histogram(t, None).collect()} == {0, 1, 2, 3}
