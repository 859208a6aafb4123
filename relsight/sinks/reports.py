"""The report files: which columns each has, under which names, in which order, and the writer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsight.operators import interesting, metrics, stats

# Column names of the files that differ from those of the operators.
RENAMED = {"conf_ab": "conf(A->B)", "conf_ba": "conf(B->A)", "lift_ab": "lift(A->B)", "lift_ba": "lift(B->A)"}
PAIRS = ["p_a", "p_b", "n_ab", "n_a", "n_b", "support_ab", "jaccard", "pmi", "conf_ab", "conf_ba", "lift_ab", "lift_ba"]
RULES = ["p_a", "p_b", "support_ab", "conf_ab", "lift_ab", "jaccard", "pmi"]
DEGREES = [f"{f}_{d}_degree_p" for d in ("out", "in") for f in ("avg", "std", "min", "max")]
SUMMARY = ["predicate", "count", "share", "unique_subjects", "unique_objects", *DEGREES, "pct_subjects_with_p", "unique_s_o_pairs", "duplicate_excess", "subj_IRI", "subj_BNODE", "obj_IRI", "obj_BNODE", "obj_LITERAL", "literals_total", "unique_datatypes", "unique_langs"]

Report = tuple[DataFrame, list[Column]]


def by(df: DataFrame, columns: list[str], *order: str, **names: str) -> Report:
    """``df`` with the file's columns and names, and its order (``-name``: descending)."""
    named = RENAMED | names
    keys = [F.desc(f"`{named.get(o[1:], o[1:])}`") if o.startswith("-") else F.asc(f"`{named.get(o, o)}`") for o in order]
    return df.select(*[F.col(c).alias(named.get(c, c)) for c in columns]), keys


def ranked_pairs(pairs: DataFrame) -> Report:
    return by(pairs, PAIRS, "-n_ab", "p_a", "p_b")


def ranked_rules(pairs: DataFrame, min_support: float, min_conf: float) -> Report:
    """Rules in the order of their pairs' counts."""
    kept = pairs.where((F.col("support_ab") >= min_support) & (F.col("conf_ab") >= min_conf))
    df = kept.select(*[F.col(c).alias(RENAMED.get(c, c)) for c in RULES], F.col("n_ab").alias("_n_ab"))
    return df, [F.desc("_n_ab"), F.asc("p_a"), F.asc("p_b")]


def profile_rdf(triples: DataFrame, alias: DataFrame | None = None, topk: int = 200, max_preds_per_subject: int = 50, min_support: float = 0.01, min_conf: float = 0.5, unique_so: bool = False, duplicate_excess: bool = False, top_values: int = 50) -> dict[str, Report]:
    """Files 1 to 5 of triples, and 8 to 13 of the chosen predicates (``alias``: p, display)."""
    always = alias.select("p") if alias is not None else None
    sets = stats.predicate_sets(triples, topk, max_preds_per_subject, always)
    pairs = stats.cooccurrence_of(sets)
    basic = stats.per_predicate(triples)
    # Pair columns are blank unless asked for, and when predicates are chosen; the second flag fills both.
    wanted = alias is None and (unique_so or duplicate_excess)
    for c in ("unique_s_o_pairs", "duplicate_excess"):
        shown = wanted and (c == "unique_s_o_pairs" or duplicate_excess)
        basic = basic if shown else basic.withColumn(c, F.lit(None).cast("long"))
    out = {
        "1_predicate_distribution": by(stats.distribution(triples), ["predicate", "count", "share"], "-count", "predicate"),
        "1_meta_entropy_gini": by(stats.meta(triples), ["n", "n_predicates", "entropy_bits", "gini"], n="N_triples", n_predicates="N_predicates"),
        "2_per_predicate_basic": by(basic, ["predicate", "count", "share", "unique_subjects", "unique_objects", "avg_out_degree_p", "avg_in_degree_p", "pct_subjects_with_p", "unique_s_o_pairs", "duplicate_excess"], "-count", "predicate"),
        "3_predicate_cooccurrence": ranked_pairs(pairs),
        "4_association_rules": ranked_rules(pairs, min_support, min_conf),
        "5_per_predicate_graph_metrics": by(metrics.graph_metrics(sets, metrics.graph_nodes(triples, topk, always, False)), ["predicate", "deg_centrality", "weighted_degree", "pagerank"], "predicate"),
    }
    if alias is not None:
        chosen = interesting.cooccurrence_of(sets, alias)
        ruled = chosen.join(alias.select(F.col("display").alias("p_a")).distinct(), "p_a", "left_semi")
        out |= {
            "8_interesting_predicates_summary": by(interesting.summary(triples, alias), SUMMARY, "predicate"),
            "9_interesting_predicates_datatypes": by(interesting.literal_counts(triples, alias, "datatype"), ["predicate", "datatype", "count", "share_among_literals"], "predicate", "-count", "datatype"),
            "10_interesting_predicates_langs": by(interesting.literal_counts(triples, alias, "lang"), ["predicate", "lang", "count", "share_among_literals"], "predicate", "-count", "lang"),
            "11_interesting_predicates_top_objects": by(interesting.top_objects(triples, alias, top_values), ["predicate", "object_iri", "count", "share_among_predicate"], "predicate", "-count", "object_iri"),
            "12_interesting_predicates_cooccurrence": ranked_pairs(chosen),
            "13_interesting_predicates_rules": ranked_rules(ruled, min_support, min_conf),
        }
    return out


def profile_edges(edges: DataFrame, nodes: DataFrame | None = None, chosen: list[str] | None = None, scope: str = "subset", topk: int = 200, max_preds_per_subject: int = 50, min_support: float = 0.01, min_conf: float = 0.5) -> dict[str, Report]:
    """Files 1 to 7 of an edge table; scope subset keeps the chosen types before everything, any adds files 3b and 4b."""
    if scope not in ("subset", "any"):
        raise ValueError("scope is subset or any")
    t = edges.where(F.col("p").isin(chosen)) if chosen and scope == "subset" else edges
    sets = stats.predicate_sets(t, topk, max_preds_per_subject)
    pairs = stats.cooccurrence_of(sets)
    rel = {"predicate": "rel_type"}
    out = {
        "1_predicate_distribution": by(stats.distribution(t), ["predicate", "count", "share"], "-count", "predicate", **rel),
        "1_meta_entropy_gini": by(stats.meta(t), ["n", "n_predicates", "entropy_bits", "gini"], n="N_edges", n_predicates="N_rel_types"),
        "2_per_predicate_basic": by(stats.per_predicate(t), ["predicate", "count", "share", "unique_subjects", "unique_objects", *DEGREES], "-count", "predicate", **rel),
        "3_predicate_cooccurrence": ranked_pairs(pairs),
        "4_association_rules": ranked_rules(pairs, min_support, min_conf),
        "5_per_predicate_graph_metrics": by(metrics.graph_metrics(sets, metrics.graph_nodes(t, topk)), ["predicate", "deg_centrality", "weighted_degree", "pagerank"], "predicate", **rel),
    }
    if chosen and scope == "any":
        hit = pairs.where(F.col("p_a").isin(chosen) | F.col("p_b").isin(chosen))
        out["3b_predicate_cooccurrence_interesting"] = ranked_pairs(hit)
        out["4b_association_rules_interesting"] = ranked_rules(hit, min_support, min_conf)
    if nodes is not None:
        for number, side, end in ((6, "subject", "s"), (7, "object", "o")):
            names = {"p": "rel_type", "category": f"{side}_category", "share": "share_among_rel"}
            out[f"{number}_{side}_category_counts"] = by(stats.category_counts(t, nodes, end), ["p", "category", "count", "share"], "p", "-count", "category", **names)
    return out


def plot_data(triples: DataFrame, alias: DataFrame | None = None, top: int = 30, topk: int = 200, cap: int = 50, label: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """What the plots show: histogram of counts, top bars, and heat maps as rows. ``label`` adds the text that stands for a predicate."""
    top = max(1, top)
    most = stats.top_predicates(triples, top)
    sets = stats.predicate_sets(triples, topk, cap, alias.select("p") if alias is not None else None)
    best = stats.support(sets).orderBy(F.desc("n"), "p").limit(top).select("p")
    out = {"histogram": stats.histogram(triples, None), "top": most, "heatmap": stats.heatmap_of(stats.within(sets, best))}
    if alias is not None:
        out["interesting_heatmap"] = interesting.heatmap_of(sets, alias, top)
    if label is None:
        return out
    names = {"p": "label", "p_a": "label_a", "p_b": "label_b"}
    return {name: df.select("*", *[label(F.col(c)).alias(names[c]) for c in df.columns if c in names]) for name, df in out.items()}


def save(report: Report, folder: str, name: str) -> str:
    """Write one report as ``folder/name.csv`` with a header. Reports have a row a predicate or pair, so one task writes them."""
    df, order = report
    spark = df.sparkSession
    shown = [c for c in df.columns if not c.startswith("_")]
    parts = f"{folder.rstrip('/')}/.{name}-{uuid.uuid4().hex}"
    # What made the rows keeps its tasks; only finished rows meet in one.
    rows = df.repartition(1).sortWithinPartitions(*order) if order else df.repartition(1)
    rows.select(*[f"`{c}`" for c in shown]).write.csv(parts, header=True, escape='"', emptyValue="", nullValue="")
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.csv")
    files = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
    files.delete(target, False)
    files.rename(found[0], target)
    files.delete(source, True)
    return target.toString()


def save_all(reports: dict[str, Report], folder: str) -> list[str]:
    return [save(report, folder, name) for name, report in reports.items()]


def save_ntriples(triples: DataFrame, folder: str) -> None:
    """Triples of term tokens as N-Triples text, which Turtle readers take as well."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(folder)
