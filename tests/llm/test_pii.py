import hashlib
import random
import re

from pyspark.sql import functions as F

from relsight.llm import pii, queries
from relsight.llm.pii import KINDS

SF = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    """The base rules by Python's own matcher."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def row_of(spans):
    counts = tuple(sum(k == i for _, k, _ in spans) for i in range(4))
    named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*counts, hashlib.sha256(named.encode()).hexdigest()), named


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want, named = row_of(brute(texts[r.doc_id]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, (r, named)
        assert not named or set(named.split(",")) <= set(r.spans.split(","))


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    check(queries.op7_pii(spark, SF).collect(), texts)


def test_made_texts_against_brute_force(spark, tmp_path):
    random.seed(11)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-5555", "+", "12", ".", " ", "é", "😀", "token=ab12cd34", "5", "-"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randrange(30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "a@b.c " * 3000 + "é" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op7_pii(spark, str(tmp_path)).collect(), dict(rows))


def test_names_clash_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cd", "x", "y", 5)], "doc_id long, text string, base string, all string, _t int").withColumn("PII", F.lit(3))
    (r,) = pii.find(rows, pii.fit(rows)).collect()
    assert (r.base, r["all"], r._t) == ("x", "y", 5) and [tuple(x) for x in r.pii.base] == [(5, 0, 11)]
    none = rows.where("false")
    assert pii.find(none, pii.fit(none)).count() == 0


def test_redaction_is_whole(spark):
    secret = "aB3_" * 75
    text = f'é😀 token = "{secret}" mail a@b.cd, a@b.cd {"x" * 50}'
    rows = spark.createDataFrame([(1, text), (2, "pwd=me@b.cd!9x end")], "doc_id long, text string")
    out = {r.doc_id: r.t for r in pii.find(rows, pii.fit(rows)).select("doc_id", pii.redact(F.col("text"), F.col("pii.all")).alias("t")).collect()}
    assert out[1] == f"é😀 [SECRET] mail [EMAIL], [EMAIL] {'x' * 50}" and out[2] == "[SECRET] end"


def test_long_values_are_whole(spark):
    long = "aB3_" * 1500
    cases = {
        "secret": (f'token="{long}"', f'token="{long}"'),
        "digest": (f"see {'0a1b' * 1500} there", "0a1b" * 1500),
        "handle": (f"of {long}@{long} here", f"{long}@{long}"),
        "number": (f"no {'12 34-' * 1000}5 more", f"{'12 34-' * 1000}5"),
    }
    rows = spark.createDataFrame([(k, text) for k, (text, _) in cases.items()], "k string, text string")
    for i, name in enumerate(pii.ADDED):
        if name in cases:
            (r,) = rows.where(F.col("k") == name).select(pii.spans(F.col("text"), pii.GENERATORS[name], i).alias("s")).collect()
            assert [x.match for x in r.s] == [cases[name][1]], name


def test_every_marked_secret_of_the_documents_goes(spark):
    """Values after a cue that mix letters and digits, of any case and whatever follows their quote."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.where("text rlike '(?i)password|passwd|pwd|token|secret|key'").collect()}
    marked = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?([^\s\"']{6,})[\"']?")
    want = {(d, m.start(), m.end(), m[1]) for d, t in texts.items() for m in marked.finditer(t) if re.search("[A-Za-z]", m[1]) and re.search("[0-9]", m[1])}
    some = docs.join(F.broadcast(spark.createDataFrame([(d,) for d in texts], "doc_id long")), "doc_id", "left_semi")
    found = pii.find(some, pii.fit(docs)).select("doc_id", pii.named(F.col("pii.all")).alias("s"), pii.redact(F.col("text"), F.col("pii.all")).alias("t")).collect()
    spans = {(r.doc_id, x) for r in found for x in r.s.split(",")}
    assert len(want) > 150 and all((d, f"secret:{a}:{b}") in spans for d, a, b, _ in want)
    left = {r.doc_id: r.t for r in found}
    assert not [d for d, _, _, value in want if value in left[d]]


def test_added_kinds(spark):
    texts = {1: "call: 555 123 4567 now", 2: "mac 00:1b:44:11:3a:b7 ok", 3: "at 2001:0db8:0000:0000:0000:ff00:0042:8329 ok", 4: "ask root@localhost ok", 5: f"sum {'0a' * 20} ok", 6: "TOKEN = \"9233A8ECFF00\"!!", 7: "token=abcdefgh", 8: "in 1234567 of 12:30:45:10", 9: f"id {'12' * 20}", 10: "plain words @ 5 or a@ b"}
    want = {1: "number:6:18", 2: "address:4:21", 3: "address:3:42", 4: "handle:4:18", 5: "digest:4:44", 6: "secret:0:22", 7: "", 8: "", 9: "", 10: ""}
    rows = spark.createDataFrame([(100 * i + k, f"{t} {'x' * i}") for i in range(20) for k, t in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.find(rows, pii.fit(rows)).select("doc_id", pii.named(F.col("pii.all")).alias("s")).collect()}
    assert {d: s for d, s in found.items() if s != want[d % 100]} == {}


def test_rare_secrets_train_at_any_size(spark):
    # Secrets only in documents that a hash sample of one in two leaves out.
    rare = (F.col("id") % 1000 == 5) & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)) == 1)
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(rare, F.concat(F.lit("password=abc123def"), F.col("id"))).otherwise("plain words").alias("text"))
    want = {r.id for r in spark.range(40_000).where(rare).collect()}
    found = pii.find(rows, pii.fit(rows)).where(F.size("pii.all") > 0).select("doc_id", pii.named(F.col("pii.all")).alias("s")).collect()
    assert want and {(r.doc_id, r.s) for r in found} == {(i, f"secret:0:{18 + len(str(i))}") for i in want}
