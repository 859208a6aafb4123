"""A synthetic heritage graph: places, space-time volumes, periods and objects with relations between them.

Every draw is a hash of (seed, kind, number, what for), so the same arguments
give the same graph, however many tasks make it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces, classes and the range of dates.
CRM, EX = "http://www.cidoc-crm.org/cidoc-crm/", "http://example.org/id/"
TYPE, LABEL, DATE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#label>", "http://www.w3.org/2001/XMLSchema#date"
FIRST_DAY, LAST_DAY = "1700-01-01", "2025-01-01"
KINDS = {"place": ("E53_Place", "Synthetic Place"), "stv": ("E92_Spacetime_Volume", "SpacetimeVolume"), "period": ("E4_Period", "Period"), "object": ("E19_Physical_Object", "Artefact")}


def draw(seed: int, kind: str, i: Column, what: str) -> Column:
    """A number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(kind), i.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long")


def node(seed: int, kind: str, i: Column) -> Column:
    return F.concat(F.lit(f"<{EX}{kind}/"), F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), F.lit(kind), i.cast("string")), 256), 1, 32), F.lit(">"))


def heritage_graph(spark: SparkSession, periods: int = 10, places: int = 10, objects: int = 15, spacetime: int = 10, density: float = 0.3, seed: int = 0, locale: str = "en_US") -> DataFrame:
    """Distinct (s, p, o) term tokens. ``density``, taken into [0, 1], is the chance of each optional relation."""
    density = min(1.0, max(0.0, density))
    sizes = {"place": places, "stv": spacetime, "period": periods, "object": objects}
    needs = {"place": ["stv", "period", "object"], "period": ["object"]}
    for kind, users in needs.items():
        if not sizes[kind] and any(sizes[u] for u in users):
            raise ValueError(f"no {kind} to choose from")
    parts: list[DataFrame] = []
    language = locale.split("_")[0]

    def add(rows: DataFrame, s: Column, p: str, o: Column) -> None:
        parts.append(rows.select(s.alias("s"), F.lit(p if p.startswith("<") else f"<{CRM}{p}>").alias("p"), o.alias("o")))

    def pick(kind: str, what: str, among: str) -> Column:
        return F.pmod(draw(seed, kind, F.col("id"), what), F.lit(max(1, sizes[among])))

    def relate(kind: str, name: str, itself: bool, chance: float, both: bool) -> None:
        """Each one to itself, and by chance to one other, perhaps both ways."""
        rows, me = spark.range(sizes[kind]), node(seed, kind, F.col("id"))
        if itself:
            add(rows, me, name, me)
        some = rows.where(draw(seed, kind, F.col("id"), f"{name} if") < int(chance * (1 << 32))).withColumn("to", pick(kind, name, kind)).where("to <> id")
        other = node(seed, kind, F.col("to"))
        add(some, me, name, other)
        if both:
            add(some, other, name, me)

    def choose(kind: str, name: str, among: str) -> None:
        add(spark.range(sizes[kind]), node(seed, kind, F.col("id")), name, node(seed, among, pick(kind, name, among)))

    for kind, (cls, label) in KINDS.items():
        rows, me = spark.range(sizes[kind]), node(seed, kind, F.col("id"))
        add(rows, me, TYPE, F.lit(f"<{CRM}{cls}>"))
        add(rows, me, LABEL, F.concat(F.lit(f'"{label} '), (F.col("id") + 1).cast("string"), F.lit(f'"@{language}')))
    days = F.datediff(F.to_date(F.lit(LAST_DAY)), F.to_date(F.lit(FIRST_DAY)))
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(draw(seed, "stv", F.col("id"), "day"), days + 1).cast("int"))
    add(spark.range(spacetime), node(seed, "stv", F.col("id")), "P4_has_time_span", F.concat(F.lit('"'), day.cast("string"), F.lit(f'"^^<{DATE}>')))
    relate("place", "P89_falls_within", True, density, False)
    choose("stv", "P161_has_spatial_projection", "place")
    relate("stv", "P121_overlaps_with", True, density, True)
    relate("stv", "P189_approximates", True, density / 2, False)
    relate("stv", "P133_is_spatiotemporally_separated_from", False, density, True)
    choose("period", "P7_took_place_at", "place")
    relate("period", "P10_falls_within", True, density, False)
    relate("period", "P9_consists_of", False, density, False)
    choose("object", "P55_has_current_location", "place")
    choose("object", "P108i_was_produced_by", "period")
    return reduce(DataFrame.union, parts).distinct()
