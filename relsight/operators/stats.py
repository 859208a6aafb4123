"""Distribution, degree, pair and co-occurrence statistics of (s, p, o) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsight.operators.shared import written


def share(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(0.0)


def distribution(t: DataFrame) -> DataFrame:
    """predicate, count, share. The window runs over one row a predicate."""
    counts = t.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("predicate", "count", share(F.col("count"), F.col("total")).alias("share"))


def meta(t: DataFrame) -> DataFrame:
    """n, n_predicates, entropy_bits, gini (Gini-Simpson); zeros for no rows."""
    d, p = distribution(t), F.col("share")
    entropy = F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))
    gini = F.when(F.count("*") > 0, 1 - F.sum(p * p)).otherwise(0.0)
    return d.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("n_predicates"), entropy.alias("entropy_bits"), gini.alias("gini"))


def degrees(t: DataFrame, end: str, prefix: str) -> DataFrame:
    """Rows and distinct ends of each predicate, and avg, std, min, max of the ends' degrees, by two aggregations."""
    by_end = t.groupBy("p", end).agg(F.count("*").alias("d"))
    mean = F.sum("d") / F.count("*")
    std = F.sqrt(F.greatest(F.sum(F.col("d") * F.col("d")) / F.count("*") - mean * mean, F.lit(0.0)))
    unique = "unique_subjects" if end == "s" else "unique_objects"
    return by_end.groupBy("p").agg(F.sum("d").alias("count"), F.count("*").alias(unique), mean.alias(f"avg_{prefix}"), std.alias(f"std_{prefix}"), F.min("d").alias(f"min_{prefix}"), F.max("d").alias(f"max_{prefix}"))


def duplicates(t: DataFrame) -> DataFrame:
    """unique_s_o_pairs and duplicate_excess (null without duplicates)."""
    pairs = t.groupBy("p", "s", "o").agg(F.count("*").alias("n"))
    return pairs.groupBy("p").agg(F.count("*").alias("unique_s_o_pairs"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("duplicate_excess"))


def n_subjects(t: DataFrame) -> DataFrame:
    return t.agg(F.countDistinct("s").alias("n_subjects"))


def per_predicate(t: DataFrame) -> DataFrame:
    """All basic columns of each predicate, from one aggregate each of its subjects, objects and pairs; counts and shares come with the subjects'."""
    out, into, pairs = degrees(t, "s", "out_degree_p"), degrees(t, "o", "in_degree_p"), duplicates(t)
    total = F.sum("count").over(Window.partitionBy())  # over a row a predicate
    joined = out.withColumn("share", share(F.col("count"), total)).join(into.drop("count"), "p").join(pairs, "p").crossJoin(F.broadcast(n_subjects(t)))
    found = [c for c in joined.columns if c not in ("p", "count", "share", "n_subjects")]
    return joined.select(F.col("p").alias("predicate"), "count", "share", *found, (100 * share(F.col("unique_subjects"), F.col("n_subjects"))).alias("pct_subjects_with_p"))


def top_predicates(t: DataFrame, k: int) -> DataFrame:
    return t.groupBy("p").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "p").limit(k)


def shown(t: DataFrame, k: int, always: DataFrame | None = None) -> DataFrame | None:
    """p of the top k predicates (0: none) and of ``always``; nothing, which stands for all, where that is none."""
    if k <= 0 and (always is None or always.isEmpty()):
        return None
    top = top_predicates(t, k).select("p") if k > 0 else always.select("p")
    return top.union(always.select("p")).distinct() if always is not None else top


def subject_predicates(t: DataFrame, k: int = 200, cap: int = 50, always: DataFrame | None = None) -> DataFrame:
    """Distinct (s, p) within ``shown`` and each subject's first ``cap`` of them (0: all)."""
    rows, top = t.select("s", "p"), shown(t, k, always)
    rows = (rows.join(top, "p", "left_semi") if top is not None else rows).distinct()
    if cap > 0:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("p"))).where(F.col("r") <= cap).drop("r")
    return rows.select("s", "p")


#: Predicates that a mask has bits for, and the bits of one of its words.
MASKED, BITS = 1024, 63


def predicate_sets(t: DataFrame, k: int = 200, cap: int = 50, always: DataFrame | None = None) -> DataFrame:
    """ps, n: the distinct sets of predicates that subjects have (also the empty one), and each one's number of subjects.

    Sets are within ``shown`` and are cut to the first ``cap`` by name (0: whole). Up to MASKED predicates, a
    subject's set is bits of a few numbers, so that a subject, however many
    rows it has, is one row of fixed width after the partial aggregation; cuts
    and names come after equal sets have met. The sets, from which all else
    about pairs follows, are written to the shared folder.
    """
    most, top = max(k, 0) + (always.count() if always is not None else 0), shown(t, k, always)
    if top is None or most > MASKED:
        return written(sets_of(subject_predicates(t, k, cap, always), t), "sets")
    # At most ``most`` names; a name's place among them is its bit.
    names = top.agg(F.sort_array(F.collect_list("p")).alias("names"))
    bits = names.select(F.posexplode("names").alias("bit", "p"))
    rows = t.select("s", "p").join(F.broadcast(bits), "p", "left")
    place = F.col("bit") % BITS
    words = range(-(-most // BITS))
    mask = [F.bit_or(F.when(F.floor(F.col("bit") / BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(0)).alias(f"w{w}") for w in words]
    masks = rows.groupBy("s").agg(*mask).groupBy(*[f"w{w}" for w in words]).agg(F.count("*").alias("n"))
    has = lambda i: F.call_function("shiftright", F.get(F.array(*[f"w{w}" for w in words]), F.floor(i / BITS).cast("int")), i % BITS).bitwiseAND(F.lit(1)) == 1
    held = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: has(i))
    held = F.slice(held, 1, cap) if cap > 0 else held
    return written(masks.select("n", held.alias("held")).crossJoin(F.broadcast(names)).select(F.transform("held", lambda i: F.get("names", i)).alias("ps"), "n"), "sets")


def sets_of(sp: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """ps, n of distinct (s, p); with ``t``, subjects of it that ``sp`` lacks have the empty set."""
    sets = sp.groupBy("s").agg(F.sort_array(F.collect_set("p")).alias("ps")).groupBy("ps").agg(F.count("*").alias("n"))
    if t is None:
        return sets
    rest = n_subjects(t).crossJoin(sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("had"))).select(F.array().cast("array<string>"), F.col("n_subjects") - F.col("had"))
    return sets.union(rest)


def subjects(sets: DataFrame) -> DataFrame:
    """n_subjects of sets that also count those without a set."""
    return sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_subjects"))


def support(sets: DataFrame) -> DataFrame:
    """p, n: the subjects whose set has p."""
    return sets.select(F.explode("ps").alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))


def pair_counts(sets: DataFrame) -> DataFrame:
    """p_a < p_b and the subjects with both. Pairs come from each distinct set once, however many subjects have it."""
    pairs = F.flatten(F.transform("ps", lambda a, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda b: F.struct(a.alias("p_a"), b.alias("p_b")))))
    return sets.select(F.explode(pairs).alias("x"), "n").groupBy("x.p_a", "x.p_b").agg(F.sum("n").alias("n_ab"))


def associate(pairs: DataFrame, supports: DataFrame, total: DataFrame) -> DataFrame:
    """Support, Jaccard, PMI, confidences and lifts of pairs."""
    rows = pairs.join(supports.select(F.col("p").alias("p_a"), F.col("n").alias("n_a")), "p_a").join(supports.select(F.col("p").alias("p_b"), F.col("n").alias("n_b")), "p_b")
    # One row, whatever the data.
    rows = rows.crossJoin(F.broadcast(total))
    n, ab, a, b = (F.col(c) for c in ("n_subjects", "n_ab", "n_a", "n_b"))
    s_ab, s_a, s_b = share(ab, n), share(a, n), share(b, n)
    conf_ab, conf_ba = share(ab, a), share(ab, b)
    pmi = F.when((s_ab > 0) & (s_a > 0) & (s_b > 0), F.log2(s_ab / (s_a * s_b))).otherwise(0.0)
    lift = lambda c, s: F.when(s > 0, c / s).otherwise(0.0)
    return rows.select("p_a", "p_b", "n_ab", "n_a", "n_b", s_ab.alias("support_ab"), share(ab, a + b - ab).alias("jaccard"), pmi.alias("pmi"), conf_ab.alias("conf_ab"), conf_ba.alias("conf_ba"), lift(conf_ab, s_b).alias("lift_ab"), lift(conf_ba, s_a).alias("lift_ba"))


def cooccurrence(t: DataFrame, k: int = 200, cap: int = 50, always: DataFrame | None = None) -> DataFrame:
    return cooccurrence_of(predicate_sets(t, k, cap, always))


def cooccurrence_of(sets: DataFrame) -> DataFrame:
    return associate(pair_counts(sets), support(sets), subjects(sets))


def rules(pairs: DataFrame, min_support: float = 0.01, min_conf: float = 0.5) -> DataFrame:
    """Rules a -> b of the pairs that reach both thresholds."""
    kept = pairs.where((F.col("support_ab") >= min_support) & (F.col("conf_ab") >= min_conf))
    return kept.select("p_a", "p_b", "support_ab", "conf_ab", "lift_ab", "jaccard", "pmi")


def category_counts(t: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """p, category, count, share of all rows of p; a node counts under its smallest category."""
    smallest = nodes.groupBy("node_id").agg(F.min("category").alias("category"))
    return category_sums(end_counts(t, end), smallest, end)


def end_counts(t: DataFrame, end: str) -> DataFrame:
    """p, the end and n: its rows of each predicate, so that a hub is one row a predicate."""
    return t.groupBy("p", end).agg(F.count("*").alias("n"))


def category_sums(ends: DataFrame, smallest: DataFrame, end: str) -> DataFrame:
    """The same from ``end_counts`` and (node_id, category) of distinct nodes."""
    counts = ends.join(smallest, F.col(end) == F.col("node_id")).groupBy("p", "category").agg(F.sum("n").alias("count"))
    totals = ends.groupBy("p").agg(F.sum("n").alias("total"))
    return counts.join(totals, "p").select("p", "category", "count", share(F.col("count"), F.col("total")).alias("share"))


def heatmap_of(sets: DataFrame) -> DataFrame:
    """Symmetric pair counts of sets with supports on the diagonal, long form."""
    pairs = pair_counts(sets)
    return pairs.select("p_a", "p_b", "n_ab").union(pairs.select("p_b", "p_a", "n_ab")).union(support(sets).select("p", "p", "n"))


def heatmap(t: DataFrame, k: int = 200, cap: int = 50) -> DataFrame:
    return heatmap_of(predicate_sets(t, k, cap))


def within(sets: DataFrame, best: DataFrame) -> DataFrame:
    """Sets cut to the few predicates of ``best`` (p)."""
    names = best.agg(F.collect_list("p").alias("best_"))
    return sets.crossJoin(F.broadcast(names)).select(F.array_intersect("ps", "best_").alias("ps"), "n")


def histogram(t: DataFrame, bins: int | None = 10) -> DataFrame:
    """bin (from 0) and predicates in it, over equal widths of the predicate counts.

    Without a number of bins, their width is the smaller one of the range over
    log2(n) + 1 and twice the middle half's range over the cube root of n,
    which counts only if it isn't 0.
    """
    counts = t.groupBy("p").agg(F.count("*").alias("n"))
    edges = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"), F.percentile("n", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2("k") + 1)
    middle = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt("k")
    width = F.when(middle > 0, F.least(sturges, middle)).otherwise(sturges)
    number = F.lit(bins) if bins else F.when(span == 0, 1).otherwise(F.ceil(span / width))
    edges = edges.withColumn("bins", number)
    at = F.when(span == 0, 0).otherwise(F.least(F.floor((F.col("n") - F.col("lo")) * F.col("bins") / F.greatest(span, F.lit(1))), F.col("bins") - 1))
    return counts.crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("predicates"))
