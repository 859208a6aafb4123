"""Reports on chosen predicates, whose http and https forms count as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relsight.functions.iri import variants, with_terms
from relsight.operators.stats import associate, degrees, n_subjects, pair_counts, predicate_sets, rules, share, subjects, support


def aliases(chosen: DataFrame) -> DataFrame:
    """p (a form in the data) and display (the smallest chosen form that it belongs to)."""
    return chosen.where("display is not null").select("display", F.explode(variants(F.col("display"))).alias("p")).groupBy("p").agg(F.min("display").alias("display"))


def aliased(t: DataFrame, alias: DataFrame) -> DataFrame:
    return t.join(alias, "p")


def summary(t: DataFrame, alias: DataFrame) -> DataFrame:
    """One row a chosen predicate. Unique counts and degrees are merged over its forms; pairs are distinct by display."""
    out, into = degrees(t, "s", "out"), degrees(t, "o", "in")
    each = aliased(out.join(into.drop("count"), "p"), alias)
    merged = [F.sum("count").alias("count"), F.sum("unique_subjects").alias("unique_subjects"), F.sum("unique_objects").alias("unique_objects")]
    for name, unique in (("out", "unique_subjects"), ("in", "unique_objects")):
        n = F.col(unique)
        mean = F.sum("count") / F.sum(unique)
        square = F.sum((F.pow(f"std_{name}", 2) + F.pow(f"avg_{name}", 2)) * n) / F.sum(unique)
        merged += [mean.alias(f"avg_{name}_degree_p"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"std_{name}_degree_p"), F.min(f"min_{name}").alias(f"min_{name}_degree_p"), F.max(f"max_{name}").alias(f"max_{name}_degree_p")]
    terms = with_terms(aliased(t, alias))
    kinds = terms.groupBy("display").agg(
        *[F.count_if(F.col("s_kind") == k).alias(f"subj_{k}") for k in ("IRI", "BNODE")],
        *[F.count_if(F.col("o_kind") == k).alias(f"obj_{k}") for k in ("IRI", "BNODE", "LITERAL")],
        F.countDistinct("datatype").alias("unique_datatypes"),
        F.countDistinct("lang").alias("unique_langs"),
    )
    pairs = aliased(t, alias).groupBy("display", "s", "o").agg(F.count("*").alias("n")).groupBy("display").agg(F.count("*").alias("unique_s_o_pairs"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("duplicate_excess"))
    totals = t.agg(F.count("*").alias("total")).crossJoin(n_subjects(t))
    rows = each.groupBy("display").agg(*merged).join(kinds, "display").join(pairs, "display").crossJoin(F.broadcast(totals))
    rows = rows.withColumns({"share": share(F.col("count"), F.col("total")), "pct_subjects_with_p": 100 * share(F.col("unique_subjects"), F.col("n_subjects")), "literals_total": F.col("obj_LITERAL")})
    return rows.drop("total", "n_subjects").withColumnRenamed("display", "predicate")


def literal_counts(t: DataFrame, alias: DataFrame, of: str) -> DataFrame:
    """predicate, datatype or lang, count, share among the predicate's literals."""
    terms = with_terms(aliased(t, alias)).where("o_kind = 'LITERAL'")
    totals = terms.groupBy("display").agg(F.count("*").alias("total"))
    rows = terms.where(F.col(of).isNotNull()).groupBy("display", of).agg(F.count("*").alias("count"))
    return rows.join(totals, "display").select(F.col("display").alias("predicate"), of, "count", (F.col("count") / F.greatest("total", F.lit(1))).alias("share_among_literals"))


def top_objects(t: DataFrame, alias: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent object IRIs of each chosen predicate; ties by name."""
    rows = aliased(t, alias)
    totals = rows.groupBy("display").agg(F.count("*").alias("total"))
    counts = rows.where(F.col("o").startswith("<")).groupBy("display", "o").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("display").orderBy(F.desc("count"), "o"))
    top = counts.withColumn("r", rank).where(F.col("r") <= n).join(totals, "display")
    return top.select(F.col("display").alias("predicate"), F.col("o").alias("object_iri"), "count", share(F.col("count"), F.col("total")).alias("share_among_predicate"))


def cooccurrence(t: DataFrame, alias: DataFrame, k: int = 200, cap: int = 50) -> DataFrame:
    return cooccurrence_of(predicate_sets(t, k, cap, alias.select("p")), alias)


def cooccurrence_of(sets: DataFrame, alias: DataFrame) -> DataFrame:
    """Pair metrics by display, of pairs with a chosen member; both forms on a subject give a pair with itself."""
    names = lambda df, c: df.join(alias.select(F.col("p").alias(c), F.col("display").alias(f"{c}_d")), c, "left").withColumn(c, F.coalesce(f"{c}_d", c)).drop(f"{c}_d")
    pairs = names(names(pair_counts(sets), "p_a"), "p_b")
    pairs = pairs.groupBy(F.least("p_a", "p_b").alias("p_a"), F.greatest("p_a", "p_b").alias("p_b")).agg(F.sum("n_ab").alias("n_ab"))
    supports = names(support(sets), "p").groupBy("p").agg(F.sum("n").alias("n"))
    chosen = alias.select("display").distinct()
    both = associate(pairs, supports, subjects(sets)).withColumn("k", F.array("p_a", "p_b"))
    hit = both.select("p_a", "p_b", F.explode("k").alias("display")).join(chosen, "display", "left_semi").select("p_a", "p_b").distinct()
    return both.drop("k").join(hit, ["p_a", "p_b"], "left_semi")


def chosen_rules(pairs: DataFrame, alias: DataFrame, min_support: float = 0.01, min_conf: float = 0.5) -> DataFrame:
    """Rules whose antecedent is chosen."""
    return rules(pairs, min_support, min_conf).join(alias.select(F.col("display").alias("p_a")).distinct(), "p_a", "left_semi")


def match_report(t: DataFrame, alias: DataFrame) -> DataFrame:
    """display and whether any of its forms occurs."""
    seen = t.select("p").distinct().withColumn("seen", F.lit(1))
    return alias.join(seen, "p", "left").groupBy("display").agg((F.count("seen") > 0).alias("matched"))


def missing(report: DataFrame) -> DataFrame:
    """The chosen predicates that nothing matches, by name."""
    return report.where(~F.col("matched")).select("display").orderBy("display")


def heatmap(t: DataFrame, alias: DataFrame, k: int = 200, cap: int = 50, top: int = 30) -> DataFrame:
    """Symmetric pair counts by display among the chosen predicates of the largest support, supports on the diagonal."""
    return heatmap_of(predicate_sets(t, k, cap, alias.select("p")), alias, top)


def heatmap_of(sets: DataFrame, alias: DataFrame, top: int = 30) -> DataFrame:
    shown = support(sets).join(alias, "p").groupBy("display").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "display").limit(max(1, top))
    pairs = cooccurrence_of(sets, alias).select("p_a", "p_b", "n_ab").where("p_a <> p_b")
    for c in ("p_a", "p_b"):
        pairs = pairs.join(shown.select(F.col("display").alias(c)), c, "left_semi")
    return pairs.select("p_a", "p_b", "n_ab").union(pairs.select("p_b", "p_a", "n_ab")).union(shown.select("display", "display", "n"))
