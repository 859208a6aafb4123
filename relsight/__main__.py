"""Command lines: python -m relsight rdf | edges | generate | classes | validate."""

from __future__ import annotations

import argparse
import csv
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relsight.functions import iri
from relsight.functions.iri import DEFAULT_PREFIXES
from relsight.operators import interesting, logic, validate
from relsight.sinks import reports
from relsight.sources import readers
from relsight.sources.generator import heritage_graph


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="relsight")
    tools = top.add_subparsers(dest="tool", required=True)

    def profile(name: str, source: str) -> argparse.ArgumentParser:
        p = tools.add_parser(name)
        p.add_argument(source, required=True)
        p.add_argument("--outdir", required=True)
        p.add_argument("--topk", type=int, default=200)
        p.add_argument("--max-preds-per-subject", type=int, default=50)
        p.add_argument("--min-support", type=float, default=0.01)
        p.add_argument("--min-conf", type=float, default=0.5)
        p.add_argument("--plots", action="store_true", help="write what the plots show, as CSV")
        p.add_argument("--plots-dpi", type=int, default=150, help="taken, but plots are data here, not images")
        for unused in ("--tmpdir", "--chunk-lines"):
            p.add_argument(unused, help="taken, but Spark sorts and spills by itself")
        p.add_argument("--plots-topN", dest="top", type=int, default=30)
        return p

    rdf = profile("rdf", "--input")
    rdf.add_argument("--unique-so", action="store_true")
    rdf.add_argument("--duplicate-excess", action="store_true")
    rdf.add_argument("--predicates-file")
    rdf.add_argument("--top-values", type=int, default=50)
    rdf.add_argument("--prefixes")
    rdf.add_argument("--plots-curie-labels", action="store_true", help="labels of plots are CURIEs where a prefix fits")
    edges = profile("edges", "--edges")
    edges.add_argument("--nodes-glob")
    edges.add_argument("--interesting", default="")
    edges.add_argument("--interesting-scope", choices=["subset", "any"], default="subset")
    edges.add_argument("--multi-line", action="store_true", help="fields may hold line breaks")
    make = tools.add_parser("generate")
    for name, n in (("periods", 10), ("places", 10), ("objects", 15), ("spacetime", 10), ("seed", 0)):
        make.add_argument(f"--{name}", type=int, default=n)
    make.add_argument("--density", type=float, default=0.3)
    make.add_argument("--locale", default="en_US")
    make.add_argument("--output", default="synthetic.nt")
    tools.add_parser("classes").add_argument("--csv", action="store_true")
    check = tools.add_parser("validate")
    check.add_argument("--edges", required=True, help="Parquet of rel, src, dst, brc")
    check.add_argument("--outdir", required=True)
    return top


def diagnose(seen: Observation, what: str, triples: DataFrame | None = None, alias: DataFrame | None = None) -> None:
    """Skipped rows, counted as the reports read them, and chosen predicates that nothing matches, on stderr."""
    skipped = seen.get["skipped"]
    if skipped:
        print(f"skipped {skipped} {what}", file=sys.stderr)
    if alias is not None:
        report = interesting.match_report(triples, alias)
        n, matched = report.agg(F.count("*"), F.count_if("matched")).first()
        print(f"chosen predicates: {n}, of which {matched} occur", file=sys.stderr)
        for r in interesting.missing(report).limit(10).collect():
            print(f"  not found: {r.display}", file=sys.stderr)


def run(spark: SparkSession, argv: Sequence[str]) -> None:
    a = parser().parse_args(argv)
    common = lambda: {"topk": a.topk, "max_preds_per_subject": a.max_preds_per_subject, "min_support": a.min_support, "min_conf": a.min_conf}
    seen = Observation()
    if a.tool == "rdf":
        triples, alias = readers.triples(readers.text_lines(spark, a.input), seen), None
        prefixes = readers.read_prefixes(a.prefixes, DEFAULT_PREFIXES) if a.prefixes else DEFAULT_PREFIXES
        if a.predicates_file:
            alias = interesting.aliases(readers.read_predicates(spark.read.text(a.predicates_file), prefixes))
        reports.save_all(reports.profile_rdf(triples, alias, unique_so=a.unique_so, duplicate_excess=a.duplicate_excess, top_values=a.top_values, **common()), a.outdir)
        diagnose(seen, "lines that are no triples", triples, alias)
        plots = reports.plot_data(triples, alias, a.top, a.topk, a.max_preds_per_subject, lambda c: iri.label(c, prefixes, a.plots_curie_labels)) if a.plots else {}
    elif a.tool == "edges":
        t = readers.read_edges(spark, a.edges, a.multi_line, seen)
        chosen = readers.parse_interesting(a.interesting)
        nodes = readers.read_nodes(spark, readers.matching(spark, a.nodes_glob), a.multi_line) if a.nodes_glob else None
        reports.save_all(reports.profile_edges(t, nodes, chosen, a.interesting_scope, **common()), a.outdir)
        diagnose(seen, "rows with an empty field")
        plots = reports.plot_data(t.where(F.col("p").isin(chosen)) if chosen and a.interesting_scope == "subset" else t, None, a.top, a.topk, a.max_preds_per_subject) if a.plots else {}
    elif a.tool == "generate":
        reports.save_ntriples(heritage_graph(spark, a.periods, a.places, a.objects, a.spacetime, a.density, a.seed, a.locale), a.output)
        return
    elif a.tool == "classes":
        print("\n".join(class_lines(spark, a.csv)))
        return
    else:
        rows = validate.validate_all(spark.read.parquet(a.edges))
        for tag, name in validate.NAMES.items():
            reports.save((rows.where(F.col("property") == tag).select("relation", F.col("holds").alias(name)), [F.asc("relation")]), a.outdir, name)
        return
    for name, df in plots.items():
        reports.save((df, [F.asc(c) for c in df.columns]), a.outdir, f"plot_{name}")


def class_lines(spark: SparkSession, as_csv: bool) -> list[str]:
    """The 40 classes as text or CSV lines; the last one is their number."""
    rows = logic.equivalence_classes(spark).orderBy("class_no").collect()
    if not as_csv:
        return [*(f"{r.class_no}: {r.sets}" for r in rows), str(len(rows))]
    out: list[str] = []

    class Lines:
        def write(self, line: str) -> None:
            out.append(line.rstrip("\r\n"))

    writer = csv.writer(Lines())
    for r in rows:
        writer.writerow([r.class_no, *(x if x == "Ø" else "{" + x for x in r.sets.removeprefix("{").split(", {"))])
    writer.writerow(["count", len(rows)])
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("relsight").getOrCreate(), sys.argv[1:])
