"""Readers of split, packed and broken files."""

import bz2
import csv
import gzip
import io
import lzma
import random
import shutil
import subprocess

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relsight import __main__ as cli
from relsight.functions.iri import WHITE, strip
from relsight.sources import readers, tables, xz


def lines_of(df):
    return sorted(r.value for r in df.collect())


def test_xz_is_read_by_blocks(spark, tmp_path):
    random.seed(1)
    text = "".join("".join(random.choice("abcä ") for _ in range(random.randrange(80))) + random.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(4000)) + "é" * 30_000 + "\nlast"
    data = text.encode()
    cuts = [0, *sorted(random.sample(range(len(data)), 20)), len(data)]
    (tmp_path / "streams.xz").write_bytes(b"".join(lzma.compress(data[a:b]) + b"\0" * random.choice([0, 4, 8]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
    names = ["streams.xz"]
    if shutil.which("xz"):
        (tmp_path / "plain").write_bytes(data)
        with (tmp_path / "blocks.xz").open("wb") as out:
            subprocess.run(["xz", "-c", "--block-size=10000", str(tmp_path / "plain")], stdout=out, check=True)
        names.append("blocks.xz")
    want = sorted(io.StringIO(text, newline=None).read().split("\n"))
    for name in names:
        df = xz.read_xz(spark, [str(tmp_path / name)], partition=8000)
        assert df.rdd.getNumPartitions() > 10 and lines_of(df) == want
        assert lines_of(readers.text_lines(spark, str(tmp_path / name))) == want
    (tmp_path / "empty.xz").write_bytes(lzma.compress(b""))
    assert readers.text_lines(spark, str(tmp_path / "empty.xz")).count() == 0
    xz.write_xz(spark.createDataFrame([(x,) for x in want], "value string").repartition(3), f"{tmp_path}/out", 5000)
    assert lines_of(readers.text_lines(spark, f"{tmp_path}/out/*.xz")) == want
    cut = (tmp_path / "streams.xz").read_bytes()[:-100]
    (tmp_path / "cut.xz").write_bytes(cut)
    with pytest.raises(Exception, match="no stream ends here|block"):
        readers.text_lines(spark, str(tmp_path / "cut.xz")).count()


def test_quotes_across_splits(spark, tmp_path):
    """Every split size gives the rows of one reader of the whole file."""
    random.seed(2)
    parts = ["a", "b,c", 'say "x"', "line\nbreak", "\r\n", "", '""', "é", 'q"', "x" * 300, "\n\n\n"]
    rows = [[f"n{i}", "".join(random.choice(parts) for _ in range(random.randrange(4))) or "e", random.choice(["r1", 'r"2', "r,3"]), f"more {i}"] for i in range(1500)]
    path = str(tmp_path / "e.csv")
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["node_id_start", "node_id_end", "rel_type", "note"])
        out.writerows(rows[:700])
        f.write('n,5" pipe,r1,"odd" tail\nshort,row\n')
        out.writerows(rows[700:])
    with open(path, newline="", encoding="utf-8") as f:
        want = sorted((x[0].strip(), x[2].strip(), x[1].strip()) for x in list(csv.reader(f))[1:] if len(x) > 2 and x[1].strip())
    name = "spark.sql.files.maxPartitionBytes"
    for size in ("700", "5000", "128m"):
        spark.conf.set(name, size)
        try:
            got = readers.read_edges(spark, path, True)
            assert sorted((r.s, r.p, r.o) for r in got.collect()) == want
        finally:
            spark.conf.unset(name)
    assert got.rdd.getNumPartitions() >= 1
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress((tmp_path / "e.csv").read_bytes()))
    (tmp_path / "e.csv.xz").write_bytes(lzma.compress((tmp_path / "e.csv").read_bytes()))
    for end in ("gz", "xz"):
        assert sorted((r.s, r.p, r.o) for r in readers.read_edges(spark, f"{path}.{end}", True).collect()) == want


@pytest.mark.parametrize(("line", "inside", "after"), [("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', True, False), ('a"b,"c', False, True), ('a,"b""c",d', False, False), ('""",', True, False), ('"",""', False, False), ('x","y', True, True), ('"x" y,z', False, False), ('5" pipe', False, False), ('a",b"c,"', True, True)])
def test_state_after_a_line(line, inside, after):
    assert tables.inside_after(line, inside) == after


def test_node_files_in_one_scan(spark, tmp_path):
    good = "node_id,type\n" + "".join(f"g{i},T\n" for i in range(50_000))
    packed = gzip.compress(good.replace("g", "h").encode())
    (tmp_path / "nodes-a.csv").write_text('x,node_id\n"1,2", n1 \n')
    (tmp_path / "nodes-b.csv").write_text("﻿node_id,type\nn2,Q\n")
    (tmp_path / "nodes-good.csv.gz").write_bytes(packed)
    (tmp_path / "nodes-cut.csv.gz").write_bytes(gzip.compress(good.encode())[:-2000])
    (tmp_path / "nodes-bent.csv.bz2").write_bytes((lambda x: x[:3000] + b"\0\0\0\0" + x[3004:])(bz2.compress(good.encode())))
    (tmp_path / "nodes-c.csv.xz").write_bytes(lzma.compress(b"type,node_id\n,n3\n"))
    (tmp_path / "nodes-none.csv").write_text("")
    (tmp_path / "nodes-head.csv").write_text("id\n1\n")
    with pytest.warns(UserWarning, match="skipped") as told:
        nodes = readers.read_nodes(spark, tables.matching(spark, f"{tmp_path}/nodes-*"))
    assert sorted(str(w.message).split("/nodes-")[1].split(":")[0] for w in told if "skipped" in str(w.message)) == ["bent.csv.bz2", "cut.csv.gz", "head.csv", "none.csv"]
    got = {(r.node_id, r.category) for r in nodes.collect()}
    assert got == {("n1", "a"), ("n2", "Q"), ("n3", "nodes-c.csv")} | {(f"h{i}", "T") for i in range(50_000)}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    for i in range(40):
        (tmp_path / f"more-{i}.csv").write_text("node_id\nx\n")
    assert size(readers.read_nodes(spark, tables.matching(spark, f"{tmp_path}/more-*"))) == size(readers.read_nodes(spark, tables.matching(spark, f"{tmp_path}/more-1.csv")))
    assert readers.read_nodes(spark, []).count() == 0


def test_skipped_rows_are_counted_as_they_are_read(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("node_id_start,node_id_end,rel_type\na,b,r\n,b,r\na, ,r\na,b,\nc,d,r\n")
    cli.run(spark, ["edges", "--edges", str(tmp_path / "e.csv"), "--outdir", str(tmp_path / "out")])
    assert "skipped 3 rows" in capsys.readouterr().err
    (tmp_path / "t.nt").write_text("<a> <b> <c> .\nbroken\n# x\n\n  \n")
    cli.run(spark, ["rdf", "--input", str(tmp_path / "t.nt"), "--outdir", str(tmp_path / "out2")])
    assert "skipped 2 lines" in capsys.readouterr().err
    assert readers.triples(spark.read.text(str(tmp_path / "t.nt"))).agg(F.count("*")).first()[0] == 1


def test_fields_are_parsed_once(spark, tmp_path):
    """A line is parsed once, however many fields are read and tested, and splits far smaller than a file don't make as many tasks."""
    (tmp_path / "e.csv").write_text("node_id_start,node_id_end,rel_type\n" + "".join(f'a{i},"b\n{i}",r\n' for i in range(3000)))
    plan = readers.read_edges(spark, f"{tmp_path}/e.csv")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and plan.count("trim(") == 3
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "100")
    try:
        assert tables.scan(spark, [f"{tmp_path}/e.csv"], True).rdd.getNumPartitions() > 300
        got = readers.read_edges(spark, f"{tmp_path}/e.csv", True)
        assert got.count() == 3000 and got.rdd.getNumPartitions() < 60
    finally:
        spark.conf.unset(name)


def test_white_space_is_unicode_s(spark):
    every = spark.range(0x11000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    assert {r.c for r in every.where(F.col("c").rlike(r"(?U)^\s$")).collect()} == set(WHITE)
    one = spark.createDataFrame([(f" {WHITE}a{WHITE}b\n{WHITE}",), (WHITE,), (None,)], "c string").select(strip(F.col("c")).alias("c"))
    assert [r.c for r in one.collect()] == [f"a{WHITE}b", "", None]


def test_states_of_many_lines_are_those_of_each(spark):
    random.seed(3)
    for _ in range(3000):
        lines = ["".join(random.choice('a",  ') for _ in range(random.randrange(7))) if random.random() < 0.3 else random.choice(["a,b", '"a"', '"', 'x,"', '",y', "", '"a""b",c', 'x,"é']) for _ in range(random.randrange(1, 6))]
        values = pa.array(["skipped", *lines]).slice(1)
        ends = []
        for state in (False, True):
            want = []
            for line in lines:
                want.append(tables.inside_after(line, want[-1] if want else state))
            assert tables.after(values, state).tolist() == want
            ends.append(want[-1])
        assert tables.both(values, (False, True)) == tuple(ends)


def test_xz_files_begin_with_a_header(spark, tmp_path):
    lines = spark.createDataFrame([(f'"order/{i}","part/{i * 7919 % 20000}"',) for i in range(6000)], "value string").coalesce(1)
    xz.write_xz(lines, f"{tmp_path}/out", 1 << 17, "a,b")
    (file,) = (tmp_path / "out").glob("*.xz")
    text = lzma.decompress(file.read_bytes()).decode()
    assert text.startswith('a,b\n"order/0"') and text.count("\n") == 6001
    with xz.opened(str(file)) as found:
        assert len(xz.blocks(found)) == 2
    assert len(xz.compressed(text.encode())) <= 1.3 * len(lzma.compress(text.encode()))
