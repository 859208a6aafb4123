"""Distinct ends, degrees and pairs of each predicate, kept up to date as rows arrive.

The state of a key, a predicate's ends of one hash slot, is the degree of each
end and the number of ends of each degree, and no predicate is one task's.
Degrees are kept by blocks of ends, as each look into the state is a call from
Python to the JVM: a batch reads and writes the blocks of the ends that it
brings, at most all of them. A key that a batch touches gives its totals anew;
what is true after any batch is the sum of each key's latest totals.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from relsight.operators.shared import delete
from relsight.operators.stats import share

#: Keys that a predicate's ends are dealt to, and blocks of a key.
SLOTS, BLOCKS = 8, 256
TOTALS = "p string, side string, slot long, ends long, rows long, squares double, lo long, hi long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Degrees(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.degrees = handle.getMapState("degrees", "block long", "json string")
        self.ends = handle.getMapState("ends", "d long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, Counter[str]] = defaultdict(Counter)
        for part in rows:
            for block, end in zip(part["block"].tolist(), part["end"].tolist(), strict=True):
                new[block][end] += 1
        before = {d[0]: n[0] for d, n in self.ends.iterator()}
        after = Counter(before)
        for block, ends in new.items():
            found = self.degrees.getValue((block,))
            degree = json.loads(found[0]) if found else {}
            for end, more in ends.items():
                had = degree.get(end, 0)
                degree[end] = had + more
                if had:
                    after[had] -= 1
                after[had + more] += 1
            self.degrees.updateValue((block,), (json.dumps(degree, ensure_ascii=False),))
        for d, n in after.items():
            if not n:
                self.ends.removeKey((d,))
            elif before.get(d) != n:
                self.ends.updateValue((d,), (n,))
        left = {d: n for d, n in after.items() if n}
        p, side, slot = key
        yield pd.DataFrame({"p": [p], "side": [side], "slot": [slot], "ends": [sum(left.values())], "rows": [sum(d * n for d, n in left.items())], "squares": [float(sum(d * d * n for d, n in left.items()))], "lo": [min(left)], "hi": [max(left)]})

    def close(self) -> None:
        pass


def totals(rows: DataFrame) -> DataFrame:
    """The totals of the keys that a batch of a stream of (p, s, o) touches. Sides are s, o, so (pairs), and, for all predicates together, all (subjects)."""
    pair = F.to_json(F.struct("s", "o"))
    each = [("p", "s", F.col("s")), ("p", "o", F.col("o")), ("p", "so", pair), (None, "all", F.col("s"))]
    ends = F.array(*[F.struct((F.col(p) if p else F.lit("")).alias("p"), F.lit(side).alias("side"), F.coalesce(F.concat(F.lit("="), end), F.lit("")).alias("end")) for p, side, end in each])
    keyed = rows.select(F.explode(ends).alias("x")).select("x.*", F.pmod(F.xxhash64("x.end"), F.lit(SLOTS)).alias("slot"), F.pmod(F.xxhash64("x.side", "x.end"), F.lit(BLOCKS)).alias("block"))
    return keyed.groupBy("p", "side", "slot").transformWithStateInPandas(Degrees(), TOTALS, "Update", "None")


def keep_up(rows: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start a query that writes each batch's totals to ``folder``, which driver and executors share; a batch that runs again replaces its own."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")
        return totals(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(**trigger).start()
    finally:
        spark.conf.set(PROVIDER, before)


def per_predicate(spark: SparkSession, folder: str) -> DataFrame:
    """All basic columns of each predicate, as the batches so far have them."""
    found = spark.read.schema(f"{TOTALS}, batch long").parquet(f"{folder}/totals")
    values = ("ends", "rows", "squares", "lo", "hi")
    latest = found.groupBy("p", "side", "slot").agg(F.max_by(F.struct(*values), "batch").alias("x")).select("p", "side", "x.*")
    mean = F.sum("rows") / F.sum("ends")
    sums = {"ends": F.sum("ends"), "rows": F.sum("rows"), "avg": mean, "std": F.sqrt(F.greatest(F.sum("squares") / F.sum("ends") - mean * mean, F.lit(0.0))), "lo": F.min("lo"), "hi": F.max("hi")}
    by_side = latest.groupBy("p", "side").agg(F.struct(*[v.alias(k) for k, v in sums.items()]).alias("x"))
    one = by_side.where("side <> 'all'").groupBy("p").pivot("side", ["s", "o", "so"]).agg(F.first("x"))
    whole = by_side.where("side = 'all'").select(F.col("x.rows").alias("total"), F.col("x.ends").alias("n_subjects"))
    degree = [F.col(f"{side}.{of}").alias(f"{name}_{way}_degree_p") for side, way in (("s", "out"), ("o", "in")) for of, name in (("avg", "avg"), ("std", "std"), ("lo", "min"), ("hi", "max"))]
    excess = F.nullif(F.col("so.rows") - F.col("so.ends"), F.lit(0))
    return one.crossJoin(F.broadcast(whole)).select(
        F.col("p").alias("predicate"), F.col("s.rows").alias("count"), share(F.col("s.rows"), F.col("total")).alias("share"),
        F.col("s.ends").alias("unique_subjects"), F.col("o.ends").alias("unique_objects"), *degree,
        F.col("so.ends").alias("unique_s_o_pairs"), excess.alias("duplicate_excess"), (100 * share(F.col("s.ends"), F.col("n_subjects"))).alias("pct_subjects_with_p"),
    )


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a query's totals and state."""
    delete(spark, folder)
