"""The registered queries and their DuckDB equivalents.

Doubles are rounded to nine digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsight.functions import iri
from relsight.operators import interesting, logic, metrics, stats, validate
from relsight.operators.shared import delete, shared_dir, written
from relsight.plans.views import BRC, EDGES, LINES, NODES, view
from relsight.sinks import buckets, reports
from relsight.sources import generator, readers
from relsight.sources.xz import write_xz
from relsight.streaming import degrees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, CAP = 200, 50


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, base: str | None, build, oracle: str | None = None) -> None:
    """Register ``build`` over a view (or over the session when there is none)."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(view(spark, sf_dir, base) if base else spark))
    if oracle:
        ORACLES[name] = oracle


E = f"with e as ({EDGES})"
COUNTS = "c as (select p, count(*) as n from e group by p), t as (select sum(n) as n from c)"
DEG = """
dg{x} as (select p, {x}, count(*) as d from e group by p, {x}),
gr{x} as (select p, count(*) as u, sum(d) / cast(count(*) as double) as a, sqrt(greatest(sum(d * d) / cast(count(*) as double) - power(sum(d) / cast(count(*) as double), 2), 0)) as sd, min(d) as lo, max(d) as hi from dg{x} group by p)"""
TOP = f"""top as (select p from e group by p order by count(*) desc, p limit {K}),
sp as (select s, p from (select s, p, row_number() over (partition by s order by p) as r from (select distinct s, p from e where p in (select p from top))) where r <= {CAP}),
sup as (select p, count(*) as n from sp group by p), ns as (select count(distinct s) as n from e),
ab as (select a.p as p_a, b.p as p_b, count(*) as n_ab from sp a join sp b on a.s = b.s and a.p < b.p group by 1, 2)"""
COOC = """select p_a, p_b, n_ab, x.n as n_a, y.n as n_b, round(n_ab / cast(ns.n as double), 9) as support_ab,
round(n_ab / cast(x.n + y.n - n_ab as double), 9) as jaccard, round(log2((n_ab / cast(ns.n as double)) / ((x.n / cast(ns.n as double)) * (y.n / cast(ns.n as double)))), 9) as pmi,
round(n_ab / cast(x.n as double), 9) as conf_ab, round(n_ab / cast(y.n as double), 9) as conf_ba,
round(n_ab / cast(x.n as double) / (y.n / cast(ns.n as double)), 9) as lift_ab, round(n_ab / cast(y.n as double) / (x.n / cast(ns.n as double)), 9) as lift_ba
from ab join sup x on x.p = p_a join sup y on y.p = p_b cross join ns"""

query("predicate_distribution", EDGES, stats.distribution, f"{E}, {COUNTS} select p as predicate, c.n as count, round(c.n / cast(t.n as double), 9) as share from c, t")
query("meta_entropy_gini", EDGES, stats.meta, f"{E}, {COUNTS}, q as (select c.n / cast(t.n as double) as s, c.n as k from c, t) select cast(sum(k) as bigint) as n, count(*) as n_predicates, round(-sum(s * log2(s)), 9) as entropy_bits, round(1 - sum(s * s), 9) as gini from q")
query("per_predicate_basic", EDGES, stats.per_predicate, f"""{E}, {COUNTS}, {DEG.format(x='s')}, {DEG.format(x='o')}, ns as (select count(distinct s) as n from e),
pr as (select p, count(*) as u, sum(case when k > 1 then k - 1 end) as x from (select p, s, o, count(*) as k from e group by 1, 2, 3) group by p)
select c.p as predicate, c.n as count, round(c.n / cast(t.n as double), 9) as share, gs.u as unique_subjects, round(gs.a, 9) as avg_out_degree_p, round(gs.sd, 9) as std_out_degree_p, gs.lo as min_out_degree_p, gs.hi as max_out_degree_p,
g2.u as unique_objects, round(g2.a, 9) as avg_in_degree_p, round(g2.sd, 9) as std_in_degree_p, g2.lo as min_in_degree_p, g2.hi as max_in_degree_p, pr.u as unique_s_o_pairs, cast(pr.x as bigint) as duplicate_excess, round(100 * (gs.u / cast(ns.n as double)), 9) as pct_subjects_with_p
from c join grs as gs on gs.p = c.p join gro as g2 on g2.p = c.p join pr on pr.p = c.p cross join t cross join ns""")
query("unique_pairs_and_duplicates", EDGES, stats.duplicates, f"{E} select p, count(*) as unique_s_o_pairs, cast(sum(case when k > 1 then k - 1 end) as bigint) as duplicate_excess from (select p, s, o, count(*) as k from e group by 1, 2, 3) group by p")
query("topk_predicates", EDGES, lambda t: stats.top_predicates(t, K), f"{E} select p, count(*) as count from e group by p order by count(*) desc, p limit {K}")
query("subject_predicate_sets", EDGES, lambda t: stats.subject_predicates(t, K, CAP), f"{E}, {TOP} select s, p from sp")
query("predicate_support", EDGES, lambda t: stats.support(stats.predicate_sets(t, K, CAP)), f"{E}, {TOP} select p, n from sup")
query("predicate_cooccurrence", EDGES, lambda t: stats.cooccurrence(t, K, CAP), f"{E}, {TOP} {COOC}")
query("association_rules", EDGES, lambda t: stats.rules(stats.cooccurrence(t, K, CAP), 0.01, 0.5), f"{E}, {TOP}, z as ({COOC}) select p_a, p_b, support_ab, conf_ab, lift_ab, jaccard, pmi from z where support_ab >= 0.01 and conf_ab >= 0.5")
query("profile_subset", EDGES, lambda t: stats.distribution(t.where(F.col("p").isin("LIVES_IN", "BASED_IN"))), f"{E}, c as (select p, count(*) as n from e where p in ('LIVES_IN', 'BASED_IN') group by p), t as (select sum(n) as n from c) select p as predicate, c.n as count, round(c.n / cast(t.n as double), 9) as share from c, t")
query("cooccurrence_interesting_any", EDGES, lambda t: stats.cooccurrence(t, K, CAP).where("p_a = 'LIVES_IN' or p_b = 'LIVES_IN'"), f"{E}, {TOP}, z as ({COOC}) select * from z where p_a = 'LIVES_IN' or p_b = 'LIVES_IN'")
query("node_min_category", NODES, lambda n: n.groupBy("node_id").agg(F.min("category").alias("category")), f"select node_id, min(category) as category from ({NODES}) group by node_id")
for _end, _name in (("s", "subject"), ("o", "object")):
    QUERIES[f"{_name}_category_counts"] = lambda spark, sf_dir, end=_end: rounded(stats.category_counts(view(spark, sf_dir, EDGES), view(spark, sf_dir, NODES), end))
    ORACLES[f"{_name}_category_counts"] = f"{E}, {COUNTS}, m as (select node_id, min(category) as category from ({NODES}) group by 1), k as (select p, category, count(*) as n from e join m on e.{_end} = m.node_id group by 1, 2) select k.p, category, k.n as count, round(k.n / cast(c.n as double), 9) as share from k join c on c.p = k.p"
def _bucketed(end: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, mark = f"{shared_dir(spark)}/relsight", uuid.uuid4().hex
        buckets_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ends = buckets.save_ends(view(spark, sf_dir, EDGES), end, f"ends_{mark}", folder, buckets_)
        nodes = buckets.save_nodes(view(spark, sf_dir, NODES), f"nodes_{mark}", folder, buckets_)
        out = written(rounded(buckets.category_counts(ends, nodes, end)), "categories")
        for name in ("ends", "nodes"):
            buckets.drop(spark, f"{name}_{mark}", folder)
        return out

    return run


for _end, _name in (("s", "subject"), ("o", "object")):
    QUERIES[f"{_name}_category_counts_bucketed"], ORACLES[f"{_name}_category_counts_bucketed"] = _bucketed(_end), ORACLES[f"{_name}_category_counts"]
query("heatmap_matrix", EDGES, lambda t: stats.heatmap(t, K, CAP), f"{E}, {TOP} select p_a, p_b, n_ab from ab union all select p_b, p_a, n_ab from ab union all select p, p, n from sup")
query("interesting_heatmap", LINES, lambda v: interesting.heatmap(readers.triples(v), _chosen(v), K, CAP))
query("count_histogram", EDGES, stats.histogram, f"{E}, {COUNTS}, b as (select min(n) as lo, max(n) as hi from c) select cast(case when hi = lo then 0 else least(floor((c.n - lo) * 10.0 / greatest(hi - lo, 1)), 9) end as int) as bin, count(*) as predicates from c, b group by 1")
query("top_bar", EDGES, lambda t: stats.top_predicates(t, 30), f"{E} select p, count(*) as count from e group by p order by count(*) desc, p limit 30")
PAGERANK = f"""{E.replace('with e', 'with recursive e')}, {TOP},
l as (select p_a as p, p_b as q, cast(n_ab as double) as w from ab union all select p_b, p_a, n_ab from ab),
g as (select sup.p, count(l.q) as k, coalesce(sum(l.w), 0) as wd, (select count(*) from sup) as size from sup left join l on l.p = sup.p group by sup.p),
pr as (select 0 as i, p, 1 / cast(size as double) as r from g union all
select i, p, r from (select pr.i + 1 as i, y.p as p, 0.15 / max(y.size) + 0.85 * (sum(case when x.wd = 0 then pr.r else 0 end) / max(y.size) + coalesce(sum(pr.r * l.w / x.wd), 0)) as r
from pr join g x on x.p = pr.p cross join g y left join l on l.p = x.p and l.q = y.p where pr.i < 100 group by 1, 2) z),
mv as (select a.i, sum(abs(a.r - b.r)) as moved from pr a join pr b on b.p = a.p and b.i = a.i - 1 group by a.i), rest as (select coalesce(min(i), 100) as i from mv where moved < 1e-6 * (select count(*) from sup))"""
query("graph_metrics", EDGES, lambda t: metrics.graph_metrics(stats.predicate_sets(t, K, CAP), metrics.graph_nodes(t, K)), PAGERANK + " select g.p as predicate, round(case when size <= 1 then 1 else k / cast(size - 1 as double) end, 9) as deg_centrality, round(wd, 9) as weighted_degree, round(case when exists (select 1 from l) then r else 0 end, 9) as pagerank from g join pr on pr.p = g.p join rest on rest.i = pr.i")

L = f"with l as ({LINES}), v as (select value from l where value <> '' and value not like '#%'), n as (select regexp_extract(value, '(?s)^\\s*(<[^>]*>|_:[^\\s]+)\\s+(<[^>]*>)\\s+(.*)\\s*\\.\\s*$', ['s', 'p', 'o']) as x from v), t as (select x.s as s, x.p as p, x.o as o from n where x.s <> '')"
query("nt_parse", LINES, readers.triples, f"{L} select s, p, o from t")
query("nt_bad_line_count", LINES, readers.count_bad_lines, f"{L} select count(*) filter (x.s = '') as bad_lines, count(*) as lines from n")
query("term_kinds", LINES, lambda v: iri.with_terms(readers.triples(v)).groupBy("p", "s_kind", "o_kind").agg(F.count("*").alias("count")), f"{L} select p, case when s like '<%' then 'IRI' else 'BNODE' end as s_kind, case when o like '<%' then 'IRI' when o like '$_:%' escape '$' then 'BNODE' else 'LITERAL' end as o_kind, count(*) as count from t group by 1, 2, 3")
query("iri_labels", LINES, lambda v: readers.triples(v).select("p").distinct().select("p", iri.to_curie(F.col("p")).alias("curie"), iri.label(F.col("p")).alias("label"), iri.label(F.col("p"), None, False).alias("local"), iri.variants(F.col("p")).alias("variants")).withColumn("variants", F.array_join("variants", " ")), L + """, q as (select distinct p, substr(p, 2, length(p) - 2) as x from t),
k as (select *, case when x like 'http://purl.org/dc/terms/%' then 'dcterms:' || substr(x, 26) when x like 'http://schema.org/%' then 'schema:' || substr(x, 19) end as curie, regexp_extract(x, '[^/]*$') as local from q)
select p, curie, coalesce(curie, local) as label, local, p || ' ' || case when p like '<http://%' then '<https://' || substr(p, 9) else '<http://' || substr(p, 10) end as variants from k""")


def _chosen(v: DataFrame) -> DataFrame:
    names = v.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("schema:url", "dcterms:source", "http://ex.org/click", "foaf:name")])).alias("value"))
    return interesting.aliases(readers.read_predicates(names))


A = L + ", al as (select * from (values ('<http://schema.org/url>', '<http://schema.org/url>'), ('<https://schema.org/url>', '<http://schema.org/url>'), ('<http://purl.org/dc/terms/source>', '<http://purl.org/dc/terms/source>'), ('<http://ex.org/click>', '<http://ex.org/click>'), ('<https://ex.org/click>', '<http://ex.org/click>')) as q(p, display)), at_ as (select t.s, t.o, al.display from t join al on al.p = t.p)"
for _name, _build in {
    "interesting_summary": lambda t, a: interesting.summary(t, a),
    "literal_datatypes": lambda t, a: interesting.literal_counts(t, a, "datatype"),
    "literal_langs": lambda t, a: interesting.literal_counts(t, a, "lang"),
    "top_objects": lambda t, a: interesting.top_objects(t, a, 10),
    "interesting_cooccurrence": lambda t, a: interesting.cooccurrence(t, a, K, CAP),
    "interesting_rules": lambda t, a: interesting.chosen_rules(interesting.cooccurrence(t, a, K, CAP), a),
    "interesting_match_report": lambda t, a: interesting.match_report(t, a),
}.items():
    query(_name, LINES, lambda v, build=_build: build(readers.triples(v), _chosen(v)))
D = A + ", k as (select display, case when regexp_extract(o, '\\^\\^<([^>]+)>\\s*$', 1) <> '' then '<' || regexp_extract(o, '\\^\\^<([^>]+)>\\s*$', 1) || '>' when o not like '%\"@%' then '<http://www.w3.org/2001/XMLSchema#string>' end as datatype, case when o like '%\"@%' then lower(regexp_extract(o, '@([a-zA-Z0-9-]+)\\s*$', 1)) end as lang, o from at_ where o not like '<%' and o not like '$_:%' escape '$')"
ORACLES["literal_datatypes"] = D + ", d as (select display, count(*) as n from k group by 1) select k.display as predicate, datatype, count(*) as count, round(count(*) / cast(any_value(d.n) as double), 9) as share_among_literals from k join d on d.display = k.display where datatype is not null group by 1, 2"
ORACLES["interesting_match_report"] = A + ", ch as (select * from (values ('<http://schema.org/url>'), ('<http://purl.org/dc/terms/source>'), ('<http://ex.org/click>'), ('<http://xmlns.com/foaf/0.1/name>')) as q(display)) select display, display in (select al.display from al join t on t.p = al.p) as matched from ch"
_TOP = TOP.replace("from e", "from t").replace("distinct s, p from t", "distinct s, p from t").replace("with e", "with t")
ALL = _TOP.replace(f"top as (select p from t group by p order by count(*) desc, p limit {K})", f"top as (select p from (select p from t group by p order by count(*) desc, p limit {K}) union select p from al)")
NAMED = A + ", " + ALL.replace("sup as (select p, count(*) as n from sp group by p)", "sup as (select coalesce(al.display, sp.p) as p, count(*) as n from sp left join al on al.p = sp.p group by 1)").replace("ab as (select a.p as p_a, b.p as p_b, count(*) as n_ab from sp a join sp b on a.s = b.s and a.p < b.p group by 1, 2)", "ab as (select least(coalesce(x.display, a.p), coalesce(y.display, b.p)) as p_a, greatest(coalesce(x.display, a.p), coalesce(y.display, b.p)) as p_b, count(*) as n_ab from sp a join sp b on a.s = b.s and a.p < b.p left join al x on x.p = a.p left join al y on y.p = b.p group by 1, 2)") + f", z as ({COOC})"
ORACLES["interesting_cooccurrence"] = NAMED + " select * from z where p_a in (select display from al) or p_b in (select display from al)"
ORACLES["interesting_heatmap"] = NAMED + ", ch as (select distinct display as p from al join sup on sup.p = al.display), hm as (select * from ab where p_a <> p_b and p_a in (select p from ch) and p_b in (select p from ch)) select p_a, p_b, cast(sum(n_ab) as bigint) as n_ab from (select p_a, p_b, n_ab from hm union all select p_b, p_a, n_ab from hm union all select p, p, n from sup where p in (select p from ch)) q group by 1, 2"
ORACLES["interesting_rules"] = NAMED + " select p_a, p_b, support_ab, conf_ab, lift_ab, jaccard, pmi from z where support_ab >= 0.01 and conf_ab >= 0.5 and p_a in (select display from al)"
_DEG = lambda x: f"dg{x} as (select p, {x}, count(*) as d from t group by p, {x}), g{x} as (select al.display, count(*) as u, sum(d) / cast(count(*) as double) as a, sqrt(greatest(sum(cast(d as double) * d) / count(*) - power(sum(d) / cast(count(*) as double), 2), 0)) as sd, min(d) as lo, max(d) as hi, cast(sum(d) as bigint) as n from dg{x} join al on al.p = dg{x}.p group by 1)"
ORACLES["interesting_summary"] = D.replace(", k as (", f", {_DEG('s')}, {_DEG('o')}, k as (") + """,
pr as (select display, count(*) as u, sum(case when n > 1 then n - 1 end) as x from (select display, s, o, count(*) as n from at_ group by 1, 2, 3) group by 1),
kd as (select display, count(*) filter (s like '<%') as si, count(*) filter (s not like '<%') as sb, count(*) filter (o like '<%') as oi, count(*) filter (o like '$_:%' escape '$') as ob, count(*) filter (o not like '<%' and o not like '$_:%' escape '$') as ol from at_ group by 1),
lit as (select display, count(distinct datatype) as ud, count(distinct lang) as ul from k group by 1), tot as (select count(*) as total, count(distinct s) as subjects from t)
select gs.display as predicate, gs.n as count, gs.u as unique_subjects, go.u as unique_objects, round(gs.a, 9) as avg_out_degree_p, round(gs.sd, 9) as std_out_degree_p, gs.lo as min_out_degree_p, gs.hi as max_out_degree_p, round(go.a, 9) as avg_in_degree_p, round(go.sd, 9) as std_in_degree_p, go.lo as min_in_degree_p, go.hi as max_in_degree_p,
si as subj_IRI, sb as subj_BNODE, oi as obj_IRI, ob as obj_BNODE, ol as obj_LITERAL, coalesce(ud, 0) as unique_datatypes, coalesce(ul, 0) as unique_langs, pr.u as unique_s_o_pairs, cast(pr.x as bigint) as duplicate_excess, round(gs.n / cast(tot.total as double), 9) as share, round(100 * (gs.u / cast(tot.subjects as double)), 9) as pct_subjects_with_p, ol as literals_total
from gs join go on go.display = gs.display join pr on pr.display = gs.display join kd on kd.display = gs.display left join lit on lit.display = gs.display cross join tot"""
ORACLES["top_objects"] = A + ", k as (select display, o, count(*) as n from at_ where o like '<%' group by 1, 2), d as (select display, count(*) as n from at_ group by 1), r as (select *, row_number() over (partition by display order by n desc, o) as r from k) select r.display as predicate, r.o as object_iri, r.n as count, round(r.n / cast(d.n as double), 9) as share_among_predicate from r join d on d.display = r.display where r.r <= 10"
ORACLES["literal_langs"] = A + ", k as (select display, lower(regexp_extract(o, '@([a-zA-Z0-9-]+)\\s*$', 1)) as lang, count(*) as n from at_ where o like '\"%' group by 1, 2), d as (select display, sum(n) as n from k group by 1) select k.display as predicate, lang, k.n as count, round(k.n / cast(d.n as double), 9) as share_among_literals from k join d on d.display = k.display where lang <> ''"


#: Relations whose edges all have all tags, so that each property holds for some relation and fails for another.
_WHOLE = "rel in ('same_region', 'precedes', 'mutual')"


def _tagged(t: int) -> str:
    """Which other edges have the t-th tag: six of seven, but none of an eleventh, whose list of tags is null."""
    return f"({_WHOLE} or ((src * 3 + dst * 5 + {t}) % 7 <> 0 and (src + dst) % 11 <> 0))"


def _edges(e: DataFrame) -> DataFrame:
    e = e.select("rel", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    tags = F.array_compact(F.array(*[F.when(F.expr(_tagged(t)), F.lit(x)) for t, x in enumerate(validate.PROPERTIES)]))
    return e.withColumn("brc", F.when(F.expr(f"{_WHOLE} or (src + dst) % 11 <> 0"), tags))


def _b(tag: str) -> str:
    where = _tagged(validate.PROPERTIES.index(tag))
    return f"with e as (select rel, cast(src as bigint) as src, cast(dst as bigint) as dst, row_number() over () as id from ({BRC}) q where {where}), r as (select distinct rel from e), h as (select a.rel, a.src as a, b.dst as c from e a join e b on a.rel = b.rel and a.dst = b.src and a.id <> b.id)"


_VIOLATED = {
    "REF": "select rel from (select rel, src as n from e union select rel, dst from e) q where not exists (select 1 from e where e.rel = q.rel and e.src = q.n and e.dst = q.n)",
    "SYM": "select rel from e x where not exists (select 1 from e y where y.rel = x.rel and y.src = x.dst and y.dst = x.src)",
    "TRA": "select rel from h where not exists (select 1 from e where e.rel = h.rel and e.src = h.a and e.dst = h.c)",
    "IRF": "select rel from e where src = dst",
    "ASM": "select x.rel from e x join e y on y.rel = x.rel and y.src = x.dst and y.dst = x.src",
    "ANS": "select x.rel from e x join e y on y.rel = x.rel and y.src = x.dst and y.dst = x.src and x.src < x.dst",
    "ITR": "select rel from h where not exists (select 1 from e where e.rel = h.rel and e.src = h.a and e.dst = h.c)",
    "ANT": "select h.rel from h join e on e.rel = h.rel and e.src = h.a and e.dst = h.c",
}
_REPORT = []
for _tag in validate.PROPERTIES:
    _sql = f"{_b(_tag)} select rel as relation, rel {'' if _tag == 'ITR' else 'not '}in ({_VIOLATED[_tag]}) as holds from r" if _tag in _VIOLATED else _b(_tag).replace("with e as", "with recursive e as") + ", w as (select rel, src, dst from e union select w.rel, w.src, e.dst from w join e on e.rel = w.rel and e.src = w.dst) select rel as relation, rel not in (select rel from w where src = dst) as holds from r"
    query(f"val_{_tag.lower()}", BRC, lambda e, tag=_tag: validate.validate(_edges(e), tag), _sql)
    _REPORT.append(f"select relation, '{_tag}' as property, holds from ({_sql}) as v_{_tag.lower()}")
query("validation_report", BRC, lambda e: validate.validate_all(_edges(e)), " union all ".join(_REPORT))


def _mask_sql() -> str:
    """The 512 sets, their members and closures, from the lists of rules."""
    has = lambda c, names: f"({c} & {logic.mask(names)}) = {logic.mask(names)}"
    bad = lambda c: " or ".join(f"({has(c, x)}{' and not ' + has(c, ('REF',)) if x == ('SYM', 'ANS') else ''})" for x in logic.CONTRADICTIONS)
    step = " | ".join(["v", *(f"case when {has('v', a)} then {logic.mask(b)} else 0 end" for a, b in logic.IMPLICATIONS)])
    members = ", ".join(f"case when (mask & {logic.BIT[p]}) <> 0 then '{p}' end" for p in sorted(logic.BIT))
    return f"""with recursive z as (select cast(range as int) as mask, cast(range as int) as v, 0 as i from range(512) union all select mask, {step}, i + 1 from z where i < 9),
s as (select mask, list_filter([{members}], lambda x: x is not null) as members, case when not ({bad('mask')} or {bad('v')}) then v end as closure from z where i = 9)"""


query("property_closures", None, lambda spark: logic.subsets(spark).select("mask", F.array_join("members", ",").alias("members"), "closure"), _mask_sql() + " select mask, array_to_string(members, ',') as members, closure from s")
query("equivalence_classes", None, logic.equivalence_classes, _mask_sql() + """,
g as (select a.mask, any_value(a.members) as members, list(coalesce(u.closure, -1) order by t.mask) as sign from s a join s t on a.closure is not null and t.closure is not null join s u on u.mask = a.mask | t.mask group by a.mask),
c as (select sign, list(members order by len(members), members) as sets from g group by sign union all select null, list(members order by len(members), members) from s where closure is null)
select row_number() over (order by len(sets[1]), sets[1]) as class_no, len(sets) as size, array_to_string(list_transform(sets, lambda x: case when len(x) = 0 then 'Ø' else '{' || array_to_string(x, ', ') || '}' end), ', ') as sets from c""")


def _profile(name: str, scope: str, chosen: list[str], oracle: str) -> None:
    """A report file, as its columns and names are."""
    query(f"report_{name}_{scope}", EDGES, lambda t: reports.profile_edges(t, None, chosen, scope)[name][0].drop("_n_ab"), oracle)


_RULES = 'p_a, p_b, support_ab, conf_ab as "conf(A->B)", lift_ab as "lift(A->B)", jaccard, pmi'
_profile("4b_association_rules_interesting", "any", ["LIVES_IN", "ORDER_P"], f"{E}, {TOP}, z as ({COOC}) select {_RULES} from z where support_ab >= 0.01 and conf_ab >= 0.5 and (p_a in ('LIVES_IN', 'ORDER_P') or p_b in ('LIVES_IN', 'ORDER_P'))")
_profile("3_predicate_cooccurrence", "subset", ["LIVES_IN", "ORDER_P", "ORDER_O", "RET_NO"], f"with e as (select * from ({EDGES}) where p in ('LIVES_IN', 'ORDER_P', 'ORDER_O', 'RET_NO')), {TOP}, z as ({COOC}) select p_a, p_b, n_ab, n_a, n_b, support_ab, jaccard, pmi, conf_ab as \"conf(A->B)\", conf_ba as \"conf(B->A)\", lift_ab as \"lift(A->B)\", lift_ba as \"lift(B->A)\" from z")


def _through(name: str, sql: str, save: Callable[[DataFrame, str], None], load: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    """A query that writes a view's rows as files of a format into the shared folder and reads those; the files go when the result, itself a table there, is made."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/relsight/{name}-{uuid.uuid4().hex}"
        save(view(spark, sf_dir, sql), path)
        out = written(rounded(load(spark, path)), name)
        delete(spark, path)
        return out

    QUERIES[name], ORACLES[name] = run, oracle


def _edge_rows(e: DataFrame) -> DataFrame:
    return e.select(F.col("s").alias("node_id_start"), F.col("o").alias("node_id_end"), F.col("p").alias("rel_type"), F.lit("x").alias("extra"))


def _as_lines(df: DataFrame) -> DataFrame:
    """CSV lines of a table, all fields in quotes."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return df.select(F.concat_ws(",", *quoted).alias("value"))


def _noted(e: DataFrame) -> DataFrame:
    """Edge rows whose ends have line breaks, quotes and commas."""
    broken = lambda c: F.when(F.length(c) % 3 == 0, F.concat(c, F.lit('\n"a", b\n'), c)).otherwise(F.col(c))
    return e.select(broken("s").alias("node_id_start"), broken("o").alias("node_id_end"), F.col("p").alias("rel_type"))


def _parted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of edge CSVs with line breaks in fields, read by splits far smaller than a file."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        return written(readers.read_edges(spark, path, True).drop("edge_id"), "parted")
    finally:
        spark.conf.set(name, before)


def _node_files(n: DataFrame, path: str) -> None:
    """Node files of two kinds of headers, plain and packed."""
    kind = F.when(F.col("category") != "AAA", F.col("category"))
    n.select("node_id", kind.alias("type")).write.csv(f"{path}/nodes-vip.csv", header=True)
    n.where("node_id like 'part/%'").select(F.lit(1).alias("x"), F.concat(F.lit(" "), F.lower(kind)).alias("type"), F.lit("a,\"b").alias("y"), "node_id").write.csv(f"{path}/nodes-parts.csv", header=True, escape='"', compression="gzip")
    n.where("node_id like 'nation/%'").select("node_id").write.csv(f"{path}/nodes-land.csv", header=True, compression="bzip2")


_TRIMMED = f"{E} select trim(s) as s, trim(p) as p, trim(o) as o from e where trim(o) <> ''"
_through("edges_csv_gz", EDGES, lambda e, path: _edge_rows(e).write.csv(path, header=True, escape='"', compression="gzip"), lambda spark, path: readers.read_edges(spark, path).drop("edge_id"), _TRIMMED)
_through("edges_csv_xz", EDGES, lambda e, path: write_xz(_as_lines(_edge_rows(e)), path, 1 << 18, ",".join(_edge_rows(e).columns)), lambda spark, path: readers.read_edges(spark, f"{path}/*.xz").drop("edge_id"), _TRIMMED)
_BROKEN = lambda c: f"trim(case when length({c}) % 3 = 0 then {c} || chr(10) || '\"a\", b' || chr(10) || {c} else {c} end)"
_through("edges_csv_line_breaks", EDGES, lambda e, path: _noted(e).write.csv(path, header=True, escape='"'), _parted, f"{E} select {_BROKEN('s')} as s, trim(p) as p, {_BROKEN('o')} as o from e where trim(o) <> ''")
_through("nodes_csv", NODES, _node_files, lambda spark, path: readers.read_nodes(spark, readers.matching(spark, f"{path}/nodes-*.csv")), f"""with n as ({NODES}) select node_id, case when category = 'AAA' then 'vip' else category end as category from n
union all select node_id, coalesce(lower(nullif(category, 'AAA')), 'parts') from n where node_id like 'part/%' union all select node_id, 'land' from n where node_id like 'nation/%'""")
_through("ntriples_bz2", LINES, lambda v, path: v.write.text(path, compression="bzip2"), readers.read_ntriples, f"{L} select s, p, o from t")
_through("ntriples_xz", LINES, lambda v, path: write_xz(v, path, 1 << 18), lambda spark, path: readers.read_ntriples(spark, f"{path}/*.xz"), f"{L} select s, p, o from t")


_EVENTS = "select concat('user/', cast(user_id as string)) as s, event_type as p, props as o, event_id % 3 as batch from events"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-predicate columns of the events after a stream has brought them in three batches."""
    folder = f"{shared_dir(spark)}/relsight/stream-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, _EVENTS)
    stream = None
    for batch in range(3):
        # Each run of the query takes what has arrived since, with the state of the run before.
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{folder}/in")
        stream = stream or spark.readStream.schema("s string, p string, o string").parquet(f"{folder}/in")
        query = degrees.keep_up(stream, f"{folder}/kept", availableNow=True)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    out = written(rounded(degrees.per_predicate(spark, f"{folder}/kept")), "streamed")
    degrees.forget(spark, folder)
    return out


QUERIES["stream_per_predicate"] = _streamed
ORACLES["stream_per_predicate"] = ORACLES["per_predicate_basic"].replace(E, f"with e as (select s, p, o from ({_EVENTS}) q)")


def _generated_sql(n: int, density: float, seed: int) -> str:
    """Relation counts of the generated graph, from the same draws."""
    d = lambda kind, what: f"cast('0x' || substr(md5('{seed}/{kind}/' || cast(i as string) || '/{what}'), 1, 8) as bigint)"
    base = "<http://www.cidoc-crm.org/cidoc-crm/"
    one = [f"select '{base}{name}>' as p, count(*) as count from n" for name in ("P161_has_spatial_projection", "P7_took_place_at", "P55_has_current_location", "P108i_was_produced_by", "P4_has_time_span")]
    one += [f"select '{p}', 4 * count(*) from n" for p in (generator.TYPE, generator.LABEL)]
    for kind, name, itself, share, both in (("place", "P89_falls_within", 1, 1, 0), ("stv", "P121_overlaps_with", 1, 1, 1), ("stv", "P189_approximates", 1, 2, 0), ("stv", "P133_is_spatiotemporally_separated_from", 0, 1, 1), ("period", "P10_falls_within", 1, 1, 0), ("period", "P9_consists_of", 0, 1, 0)):
        some = f"select i, {d(kind, name)} % {n} as j from n where {d(kind, name + ' if')} < {int(density / share * (1 << 32))}"
        one.append(f"select '{base}{name}>', count(*) from (select i, j from ({some}) where i <> j" + (f" union select j, i from ({some}) where i <> j" if both else "") + (" union all select i, i from n" if itself else "") + ")")
    return f"with n as (select range as i from range({n})) " + " union all ".join(one)


query("generated_graph", None, lambda spark: generator.heritage_graph(spark, 500, 500, 500, 500, 0.3, 7).groupBy("p").agg(F.count("*").alias("count")), _generated_sql(500, 0.3, 7))
