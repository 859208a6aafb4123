"""Nine relation constraints per relation type, each a counterexample query.

Edges are (edge_id, rel, src, dst, brc). A check of X looks at the edges
tagged X and returns relation and holds for each type that has some.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relsight.operators.shared import drop_written, written

#: Numbers of a bitmap block, their bits, and targets that a block gets on average: half of what it holds.
WORDS, BITS, TARGETS = 16, 64, 512
#: Blocks that travel before a check looks at a sample of its nodes first, and the sample's share.
PROBED, SAMPLE = 2_000_000, 64
# The properties, and the names of their result columns.
NAMES = {"REF": "isReflexive", "SYM": "isSymmetric", "TRA": "isTransitive", "IRF": "isIrreflexive", "ASM": "isAsymmetric", "ANS": "isAntisymmetric", "ACC": "isAcyclic", "ITR": "isIntransitive", "ANT": "isAntitransitive"}
PROPERTIES = ["REF", "SYM", "TRA", "IRF", "ASM", "ANS", "ACC", "ITR", "ANT"]


def tagged(edges: DataFrame, tag: str) -> DataFrame:
    """Distinct (rel, src, dst) and their multiplicity m."""
    return edges.where(F.array_contains("brc", tag)).groupBy("rel", "src", "dst").agg(F.count("*").alias("m"))


def loops(e: DataFrame) -> DataFrame:
    return e.where("src = dst")


def out_degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("rel", F.col("src").alias("node")).agg(F.count("*").alias("deg"))


def blocks(e: DataFrame) -> DataFrame:
    """rel, node, lead, part, w0 ...: the targets of each node as bitmaps, a row a block.

    A target's block is that of the source with the most targets among those
    that have it (``lead``) and of a hash, so what a hub points to lies
    densely in a few blocks, and so does what its neighbours share with it.
    """
    led = e.join(out_degrees(e).withColumnRenamed("node", "src"), ["rel", "src"]).groupBy("rel", "dst").agg(F.max(F.struct("deg", "src")).alias("lead"))
    led = led.select("rel", "dst", F.col("lead.src").alias("lead"), F.ceil(F.col("lead.deg") / TARGETS).alias("parts"))
    led = led.withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("rel", "lead", "part").orderBy("dst")) - 1
    # What a part has above a block's bits fills further blocks.
    size = WORDS * BITS
    bits = led.withColumn("place", place).select("rel", "dst", "lead", (F.col("part") + F.col("parts") * F.floor(F.col("place") / size)).alias("part"), (F.col("place") % size).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % BITS).cast("int"))
    words = [F.bit_or(F.when(F.floor(F.col("bit") / BITS) == w, one).otherwise(0)).alias(f"w{w}") for w in range(WORDS)]
    return e.join(bits, ["rel", "dst"]).groupBy("rel", F.col("src").alias("node"), "lead", "part").agg(*words)


def product(edges: DataFrame, maps: DataFrame, kept: str) -> DataFrame:
    """rel of the edges ``sender`` to ``receiver`` for which the sender's targets break the check at the receiver.

    A sender's blocks travel along its edges, meet by receiver in a partial
    aggregation, and are tested against the receiver's own: ``open`` finds
    targets that the receiver lacks, ``closed`` those that it has.
    """
    names = [f"w{i}" for i in range(WORDS)]
    sent = edges.join(maps.withColumnRenamed("node", "sender"), ["rel", "sender"]).groupBy("rel", "receiver", "lead", "part").agg(*[F.bit_or(w).alias(w) for w in names])
    own = maps.select("rel", F.col("node").alias("receiver"), "lead", "part", *[F.col(w).alias(f"o{w}") for w in names])
    both = sent.join(own, ["rel", "receiver", "lead", "part"], "left" if kept == "open" else "inner")
    other = lambda w: F.coalesce(f"o{w}", F.lit(0).cast("long"))
    hit = [F.col(w).bitwiseAND(F.bitwise_not(other(w)) if kept == "open" else other(w)) != 0 for w in names]
    return both.where(reduce(lambda a, b: a | b, hit)).select("rel").distinct()


def searched(edges: DataFrame, rest: DataFrame, kept: str) -> DataFrame:
    """rel of the types that ``product`` finds among edges (rel, sender, receiver, size: the sender's targets), with the bitmaps of ``rest``.

    Where much would travel, a sample of the receivers is looked at first: a
    type that it decides sends no more.
    """
    travel = edges.agg(F.coalesce(F.sum(F.ceil(F.col("size") / TARGETS)), F.lit(0))).first()[0]
    if not travel:
        return rest.select("rel").where("false")
    if travel <= PROBED:
        return product(edges, blocks(rest), kept)
    maps = written(blocks(rest), "blocks")
    found = written(product(edges.where(F.pmod(F.xxhash64("receiver"), F.lit(SAMPLE)) == 0), maps, kept), "found")
    return found.union(product(edges.join(F.broadcast(found), "rel", "left_anti"), maps, kept))


def open_hops(e: DataFrame) -> DataFrame:
    """rel of the types with edges a-b, b-c (two different ones) and no a-c.

    That is an edge a-b, a not b, where b has a target that a lacks. If all of
    b's targets and b itself are a's, b has no more targets than a, but for
    itself: most types that aren't transitive show that in their degrees.
    """
    e, degrees = e.select("rel", "src", "dst"), out_degrees(e)
    looped = loops(e).select("rel", F.col("src").alias("dst"), F.lit(1).alias("looped"))
    # Edges whose end points nowhere can't break anything.
    sized = e.where("src <> dst").join(degrees.select("rel", F.col("node").alias("dst"), F.col("deg").alias("size")), ["rel", "dst"]).join(looped, ["rel", "dst"], "left")
    sized = sized.join(degrees.select("rel", F.col("node").alias("src"), F.col("deg").alias("above")), ["rel", "src"])
    sized = written(sized.select("rel", F.col("src").alias("receiver"), F.col("dst").alias("sender"), "size", (F.col("size") + 1 - F.coalesce("looped", F.lit(0)) > F.col("above")).alias("more")), "sized")
    found = sized.where("more").select("rel").distinct()
    return found.union(searched(sized.join(found, "rel", "left_anti"), e.join(found, "rel", "left_anti"), "open"))


def closed_hops(e: DataFrame) -> DataFrame:
    """rel of the types with edges a-b, b-c (two different ones) and an edge a-c, which may be one of them.

    A loop does that with a second loop or any other edge at its node; without
    loops, it is an edge a-b whose ends have a common target. The end with
    fewer targets sends them.
    """
    at = loops(e).select("rel", F.col("src").alias("node"), "m")
    ends = e.where("src <> dst").select("rel", F.explode(F.array("src", "dst")).alias("node"))
    found = written(at.where("m > 1").select("rel").union(at.join(ends, ["rel", "node"], "left_semi").select("rel")).distinct(), "found")
    rest = e.where("src <> dst").select("rel", "src", "dst").join(F.broadcast(found), "rel", "left_anti")
    degrees = out_degrees(rest)
    sized = rest.join(degrees.select("rel", F.col("node").alias("src"), F.col("deg").alias("above")), ["rel", "src"]).join(degrees.select("rel", F.col("node").alias("dst"), F.col("deg").alias("below")), ["rel", "dst"])
    # With one target, b, an end a has none in common with b, as there are no loops.
    up = F.col("above") < F.col("below")
    either = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    sized = written(sized.where("above > 1").select("rel", either("src", "dst").alias("sender"), either("dst", "src").alias("receiver"), F.least("above", "below").alias("size")), "sized")
    return found.union(searched(sized, rest, "closed"))


def directions(e: DataFrame) -> DataFrame:
    """rel and which edges each two nodes have, in one aggregation: ``up`` and ``down`` between different ones, ``loop``, and ``lone`` with an end missing."""
    some = lambda x, name: F.coalesce(F.bool_or(F.expr(x)), F.lit(False)).alias(name)
    pairs = e.groupBy("rel", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    return pairs.agg(some("src < dst", "up"), some("src > dst", "down"), some("src = dst", "loop"), some("src is null or dst is null", "lone"))


def irreflexive_part(e: DataFrame) -> DataFrame:
    """The ends of loops: every node of an edge without a loop."""
    nodes = e.select("rel", F.col("src").alias("n")).union(e.select("rel", "dst")).distinct()
    return nodes.join(loops(e).select("rel", F.col("src").alias("n")), ["rel", "n"], "left_anti")


def trimmed(e: DataFrame) -> DataFrame:
    """Edges but for those out of sources and into sinks."""
    e = e.join(e.select("rel", F.col("dst").alias("src")).distinct(), ["rel", "src"], "left_semi")
    return e.join(e.select("rel", F.col("src").alias("dst")).distinct(), ["rel", "dst"], "left_semi")


def eliminated(e: DataFrame, turn: int) -> DataFrame:
    """Edges in which some nodes have given way to edges past them.

    A node may go if its edges past it are at most twice as many as those it
    has, and goes if its draw of this turn is the smallest among the neighbours
    that may: no two neighbours go at once.
    """
    into = e.groupBy("rel", F.col("dst").alias("v")).agg(F.count("*").alias("i"))
    out = e.groupBy("rel", F.col("src").alias("v")).agg(F.count("*").alias("o"))
    draw = F.struct(F.xxhash64("rel", "v", F.lit(turn)).alias("x"), "v")
    able = into.join(out, ["rel", "v"]).where("i * o <= 2 * (i + o)").select("rel", "v", draw.alias("draw"))
    ends = e.select("rel", F.col("src").alias("v"), F.col("dst").alias("w")).union(e.select("rel", "dst", "src"))
    least = ends.join(able.select("rel", F.col("v").alias("w"), F.col("draw").alias("other")), ["rel", "w"]).groupBy("rel", "v").agg(F.min("other").alias("other"))
    gone = able.join(least, ["rel", "v"], "left").where("other is null or draw < other").select("rel", "v")
    past = e.join(gone.withColumnRenamed("v", "dst"), ["rel", "dst"]).select("rel", F.col("src").alias("a"), F.col("dst").alias("v"))
    past = past.join(e.join(gone.withColumnRenamed("v", "src"), ["rel", "src"]).select("rel", F.col("src").alias("v"), F.col("dst").alias("c")), ["rel", "v"]).select("rel", "a", "c")
    left = e.join(gone.withColumnRenamed("v", "src"), ["rel", "src"], "left_anti").join(gone.withColumnRenamed("v", "dst"), ["rel", "dst"], "left_anti")
    return left.select("rel", "src", "dst").union(past).distinct()


def cyclic(e: DataFrame) -> DataFrame:
    """rel of the types with a cycle.

    Each turn trims sources and sinks and eliminates nodes, both of which keep
    cycles as they are; long narrow parts shrink by a share a turn. A loop
    shows a cycle, and so does a type from which nothing can be trimmed; its
    edges go at once. Turns are written to the shared folder.
    """
    left, turn, found = written(e.select("rel", "src", "dst").distinct(), "left"), 0, e.select("rel").where("false")
    while True:
        cut = written(trimmed(left), "cut")
        # A row a relation type.
        sizes = left.groupBy("rel").agg(F.count("*").alias("before"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).join(cut.groupBy("rel").agg(F.count("*").alias("after")), "rel")
        now = written(sizes.select("rel", ((F.col("loops") > 0) | (F.col("before") == F.col("after"))).alias("cyclic")), "types")
        n, cycles = now.agg(F.count("*"), F.count_if("cyclic")).first()
        if cycles:
            found = found.union(now.where("cyclic").select("rel"))
            rest = cut.join(F.broadcast(now.where("cyclic")), "rel", "left_anti")
        drop_written(left)
        if n == cycles:
            drop_written(cut)
            return found
        left, turn = written(eliminated(rest if cycles else cut, turn), "left"), turn + 1
        drop_written(cut)


def _violations(e: DataFrame, tag: str) -> DataFrame:
    if tag == "REF":
        return irreflexive_part(e)
    if tag == "SYM":
        return directions(e).where("up <> down or lone")
    if tag == "TRA":
        return open_hops(e)
    if tag == "IRF":
        return loops(e)
    if tag == "ASM":
        return directions(e).where("up and down or loop")
    if tag == "ANS":
        return directions(e).where("up and down")
    if tag == "ACC":
        return cyclic(e)
    if tag == "ITR":
        return open_hops(e)
    return closed_hops(e)


def check(e: DataFrame, tag: str) -> DataFrame:
    """relation and holds, from the tagged edges. ITR holds when a two-hop without closing edge exists; the others when no counterexample does."""
    found = _violations(e, tag).select("rel").distinct().withColumn("found", F.lit(True))
    rows = e.select("rel").distinct().join(found, "rel", "left")
    holds = F.coalesce("found", F.lit(False))
    return rows.select(F.col("rel").alias("relation"), (holds if tag == "ITR" else ~holds).alias("holds"))


def validate(edges: DataFrame, tag: str) -> DataFrame:
    """relation and holds. The tagged edges are made once, and go when the result, a row a type, is there."""
    e = written(tagged(edges, tag), "tagged")
    out = written(check(e, tag), "validated")
    drop_written(e)
    return out


def validate_all(edges: DataFrame) -> DataFrame:
    """relation, property, holds. Edges are read once and kept as one row with its number for each tag."""
    marks = [F.count_if(F.array_contains("brc", tag)).alias(tag) for tag in PROPERTIES]
    e = written(edges.groupBy("rel", "src", "dst").agg(*marks), "tagged")
    parts = [check(e.where(F.col(tag) > 0).select("rel", "src", "dst", F.col(tag).alias("m")), tag).select("relation", F.lit(tag).alias("property"), "holds") for tag in PROPERTIES]
    out = written(reduce(DataFrame.union, parts), "validated")
    drop_written(e)
    return out


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {tag: (lambda e, tag=tag: validate(e, tag)) for tag in PROPERTIES}
