import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relsight.llm import chat, queries

SF = "/root/testdata/sf0.01"
SAID = "</s>[INST] <|end|> <\\/s> <\\\\|body|> <|image|> <\\|image|>"


def test_query_against_brute_force(spark):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = queries.op3_chat(spark, SF).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = convs[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def merged(parts):
    out = []
    for kind, text, ref, w, h, s, n in parts:
        if kind in ("image", "audio", "document"):
            tokens = {"image": -(-(w or 0) // 14) * -(-(h or 0) // 14), "audio": -(-int((s or 0) * 100) * 25 // 100), "document": (n or 0) * 512}[kind]
            out.append((kind, None, ref, tokens))
        elif text:
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + text, None, None)
            else:
                out.append(("text", text, None, None))
    return out


def test_parts_round_trip(spark):
    random.seed(2)
    texts = ["<|image|>", "<|", "image|>", SAID, "é😀", "", None, "<|audio|> plain"]
    make = [lambda: part("text", random.choice(texts)), lambda: part("image", ref=f"i{random.random()}", width=random.randrange(60), height=28), lambda: part("audio", ref="a", seconds=random.randrange(9) / 4), lambda: part("document", ref="d", pages=random.randrange(4)), lambda: part("other", "<|end|>")]
    convs = {c: [("assistant" if t % 2 else "user", [random.choice(make)() for _ in range(random.randrange(6))]) for t in range(random.randrange(1, 5))] for c in range(60)}
    convs[60] = [("user", [part("image", ref=str(i), width=14, height=14) for i in range(300)])]
    convs[61] = [("user" if i % 2 else "assistant", [part("text", f"{i} {SAID}")]) for i in range(600)]
    rows = spark.createDataFrame([(c, t, role, parts) for c, turns in convs.items() for t, (role, parts) in enumerate(turns)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    formatted = chat.format_chat(rows)
    for r in chat.read_back(formatted).collect():
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == [(role, merged(parts)) for role, parts in convs[r.conv_id]]
        want = "".join((p[1] or f"<|{p[0]}|>") for role, parts in convs[r.conv_id] if role == "assistant" for p in merged(parts))
        assert r.loss_text == want
    for r in formatted.collect():
        files = [p for _, parts in convs[r.conv_id] for p in merged(parts) if p[0] != "text"]
        assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(i, k, ref, n) for i, (k, _, ref, n) in enumerate(files, 1)]


@pytest.mark.parametrize("text", [SAID, "", None, "x" * 300_000])
def test_edges(spark, text):
    rows = spark.createDataFrame([(1, 0, "user", text, 1, 1), (1, 0, "user", text, 1, 1), (1, 1, "assistant", text, 1, 1), (None, None, None, text, 1, 1)], "conv_id long, turn long, role string, text string, parts_ int, t int")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chat(rows)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", text or "")] * 2 + [("assistant", text or "")]
    assert back[1].loss_text == (text or "") and [(t.role, t.text) for t in back[None].turns] == [("", text or "")]
    assert chat.read_back(chat.format_chat(rows.where(F.lit(False)))).count() == 0
