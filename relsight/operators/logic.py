"""Which sets of relation properties can't be told apart, over 9-bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relsight.operators.validate import PROPERTIES

BIT = {p: 1 << i for i, p in enumerate(PROPERTIES)}
# Sets that contradict (the fourth only without REF), and implications.
CONTRADICTIONS = [("REF", "IRF"), ("SYM", "ASM"), ("TRA", "ITR"), ("SYM", "ANS"), ("REF", "ASM"), ("REF", "ANT"), ("REF", "ACC"), ("SYM", "ACC")]
IMPLICATIONS = [
    (("ASM",), ("ANS", "IRF")),
    (("ANT",), ("IRF",)),
    (("ACC",), ("ANS", "IRF")),
    (("ASM", "TRA"), ("ACC",)),
    (("TRA", "IRF"), ("ASM", "ACC", "ANS")),
    (("SYM", "TRA"), ("REF",)),
    (("ACC",), ("ASM",)),
    (("IRF", "ANS"), ("ASM",)),
]


def mask(names) -> int:
    return sum(BIT[n] for n in names)


def has(m: Column, names) -> Column:
    return m.bitwiseAND(F.lit(mask(names))) == mask(names)


def contradictory(m: Column) -> Column:
    tests = [has(m, c) & ~has(m, ("REF",)) if c == ("SYM", "ANS") else has(m, c) for c in CONTRADICTIONS]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def step(m: Column) -> Column:
    added = F.lit(0)
    for given, gives in IMPLICATIONS:
        added = added.bitwiseOR(F.when(has(m, given), mask(gives)).otherwise(0))
    return m.bitwiseOR(added)


def subsets(spark: SparkSession) -> DataFrame:
    """mask, members (sorted names), closure (null for contradictory sets). A changing pass sets a bit, so nine passes suffice."""
    rows = spark.range(512).select(F.col("id").cast("int").alias("mask"))
    rows = rows.withColumn("c", F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.col("mask"), lambda m, _: step(m)))
    bad = contradictory(F.col("mask")) | contradictory(F.col("c"))
    return rows.select("mask", names(F.col("mask")).alias("members"), F.when(~bad, F.col("c")).alias("closure"))


def names(m: Column) -> Column:
    return F.sort_array(F.array_compact(F.array(*[F.when(m.bitwiseAND(F.lit(b)) != 0, p) for p, b in BIT.items()])))


def shown(members: Column) -> Column:
    return F.when(F.size(members) == 0, "Ø").otherwise(F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")))


def equivalence_classes(spark: SparkSession) -> DataFrame:
    """class_no, size, sets: sets that no valid set distinguishes, and the class of contradictory sets."""
    rows = subsets(spark)
    known = rows.select(F.col("mask").alias("u"), F.coalesce("closure", F.lit(-1)).alias("r"))
    valid = rows.where("closure is not null")
    # 117 x 117 masks, whatever the data.
    tests = valid.select("mask", "members").join(F.broadcast(valid.select(F.col("mask").alias("t"))), F.lit(True)).withColumn("u", F.col("mask").bitwiseOR(F.col("t")))
    tests = tests.join(F.broadcast(known), "u")
    signed = tests.groupBy("mask", "members").agg(F.sort_array(F.collect_list(F.struct("t", "r"))).alias("sign"))
    item = F.struct(F.size("members").alias("n"), "members")
    classes = signed.groupBy("sign").agg(F.sort_array(F.collect_list(item)).alias("sets")).select("sets")
    classes = classes.union(rows.where("closure is null").agg(F.sort_array(F.collect_list(item)).alias("sets")))
    order = Window.orderBy(F.element_at("sets", 1))
    return classes.select(F.row_number().over(order).alias("class_no"), F.size("sets").alias("size"), F.array_join(F.transform("sets", lambda x: shown(x["members"])), ", ").alias("sets"))
