"""Centralities of the weighted predicate graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsight.operators.shared import drop_written, written
from relsight.operators.stats import pair_counts, shown, support


#: Nodes of a graph whose ranks one row holds; a larger one is ranked by joins.
SMALL = 1000


def graph_nodes(t: DataFrame, k: int = 200, always: DataFrame | None = None, all_of_none: bool = True) -> DataFrame:
    """p of the graph's nodes: the top k predicates and ``always``, whether or not any set has them; where that is none, all or none."""
    top = shown(t, k, always)
    if top is not None:
        return top
    return t.select("p").distinct() if all_of_none else t.select("p").where("false")


def graph_metrics(sets: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, small: int = SMALL) -> DataFrame:
    """predicate, deg_centrality, weighted_degree, pagerank of ``nodes`` (p; else those of sets ps, n), linked by the pairs of the sets.

    Ranks are at rest when a round moves them by less than ``tolerance`` a
    node in sum, or after ``rounds``. They are array arithmetic in one row
    where the graph is small, else a join and an aggregation a round.
    """
    nodes = nodes if nodes is not None else support(sets).select("p")
    if nodes.count() > small:
        return by_joins(sets, nodes, damping, rounds, tolerance)
    pairs = pair_counts(sets).select("p_a", "p_b", F.col("n_ab").cast("double").alias("w"))
    both = pairs.union(pairs.select("p_b", "p_a", "w")).toDF("p", "q", "w")
    size = nodes.agg(F.count("*").alias("n"))
    deg = both.groupBy("p").agg(F.count("*").alias("k"), F.sum("w").alias("wd"))
    rows = nodes.join(deg, "p", "left").crossJoin(F.broadcast(size))
    rows = rows.select("p", "n", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("wd", F.lit(0.0)).alias("wd"))
    links = both.groupBy("p").agg(F.collect_list(F.struct("q", "w")).alias("links"))
    table = rows.join(links, "p", "left").select("p", "wd", F.coalesce("links", F.array().cast("array<struct<q:string,w:double>>")).alias("links"))
    table = table.agg(F.sort_array(F.collect_list(F.struct("p", "wd", "links"))).alias("g"))
    place = F.map_from_entries(F.transform("g", lambda x, i: F.struct(x["p"], i)))
    table = table.withColumn("place", place)
    table = table.select(F.transform("g", lambda x: x["p"]).alias("ps"), F.transform("g", lambda x: x["wd"]).alias("wd"), F.transform("g", lambda x: F.transform(x["links"], lambda e: F.struct(F.element_at(F.col("place"), e["q"]).alias("i"), e["w"].alias("w")))).alias("in"))
    n = F.size("ps").cast("double")

    def one(rank, _):
        lost = F.aggregate(F.arrays_zip(rank.alias("r"), F.col("wd").alias("d")), F.lit(0.0), lambda a, z: a + F.when(z["d"] == 0, z["r"]).otherwise(0.0))
        return F.transform(F.col("in"), lambda links: (1 - damping) / n + damping * (lost / n + F.aggregate(links, F.lit(0.0), lambda a, e: a + F.get(rank, e["i"]) * e["w"] / F.get(F.col("wd"), e["i"]))))

    def step(state, i):
        moved = lambda r: F.aggregate(F.arrays_zip(r.alias("x"), state["r"].alias("y")), F.lit(0.0), lambda a, z: a + F.abs(z["x"] - z["y"]))
        new = F.get(F.transform(F.array(one(state["r"], i)), lambda r: F.struct(r.alias("r"), (moved(r) < n * tolerance).alias("rests"))), F.lit(0))
        return F.when(state["rests"], state).otherwise(new)

    first = F.struct(F.transform("ps", lambda _: 1 / n).alias("r"), F.lit(False).alias("rests"))
    rank = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)["r"]
    ranked = table.select("ps", rank.alias("rank")).select(F.explode(F.arrays_zip("ps", "rank")).alias("x")).select(F.col("x.ps").alias("p"), F.col("x.rank").alias("pagerank"))
    any_edge = F.max(F.col("k") > 0)
    flag = rows.agg(any_edge.alias("any_edge"))
    out = rows.join(ranked, "p").crossJoin(F.broadcast(flag))
    centrality = F.when(F.col("n") <= 1, 1.0).otherwise(F.col("k") / F.greatest(F.col("n") - 1, F.lit(1)))
    return out.select(F.col("p").alias("predicate"), centrality.alias("deg_centrality"), F.col("wd").alias("weighted_degree"), F.when(F.col("any_edge"), F.col("pagerank")).otherwise(0.0).alias("pagerank"))


def by_joins(sets: DataFrame, nodes: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """The same for a graph of any size; each round is a table of the shared folder."""
    pairs = pair_counts(sets).select("p_a", "p_b", F.col("n_ab").cast("double").alias("w"))
    links = written(pairs.union(pairs.select("p_b", "p_a", "w")).toDF("p", "q", "w"), "links")
    deg = links.groupBy("p").agg(F.count("*").alias("k"), F.sum("w").alias("wd"))
    size = nodes.agg(F.count("*").alias("size"))
    rows = written(nodes.join(deg, "p", "left").na.fill(0).crossJoin(F.broadcast(size)), "nodes")
    any_edge = not links.isEmpty()
    rank = rows.select("p", "k", "wd", "size", (1 / F.col("size")).alias("r"))
    for _ in range(rounds if any_edge else 0):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("wd") == 0, F.col("r"))), F.lit(0.0)).alias("lost"))
        given = links.join(rank.where("wd > 0").select("p", (F.col("r") / F.col("wd")).alias("each")), "p").groupBy(F.col("q").alias("p")).agg(F.sum(F.col("w") * F.col("each")).alias("got"))
        new = rank.join(given, "p", "left").crossJoin(F.broadcast(lost))
        new = new.select("p", "k", "wd", "size", F.col("r").alias("was"), ((1 - damping) / F.col("size") + damping * (F.col("lost") / F.col("size") + F.coalesce("got", F.lit(0.0)))).alias("r"))
        # A round reads the ranks twice, so they are written each time: else the plan would double.
        new = written(new, "ranks")
        drop_written(rank)
        rests = new.agg(F.sum(F.abs(F.col("r") - F.col("was"))) < F.max("size") * tolerance).first()[0]
        rank = new
        if rests:
            break
    centrality = F.when(F.col("size") <= 1, 1.0).otherwise(F.col("k") / F.greatest(F.col("size") - 1, F.lit(1)))
    return rank.select(F.col("p").alias("predicate"), centrality.alias("deg_centrality"), F.col("wd").alias("weighted_degree"), (F.col("r") if any_edge else F.lit(0.0)).alias("pagerank"))
