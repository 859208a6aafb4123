"""BPE encoding and decoding, and packing, against the libraries' own results."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from relsight.llm import bpe, packing, pretokens, queries

SF = "/root/testdata/sf0.01"
MULTI, FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "a", "é", "1", "²", "!", "\x85", "日", "😀", "\x1c", "_", "<|endoftext|>", "<|endof", "Ᲊ", "\U000323b0"]


def cases():
    random.seed(0)
    out = [(i, "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))) for i in range(300)]
    return [*out, (300, None), (301, ""), (301, "twice"), (301, "twice"), (None, "no id"), (None, None), (302, "lorem ipsum é " * 20_000), (303, "x" * 100_000)]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_pretokens_follow_the_pattern():
    random.seed(0)
    parts = PARTS[:19]
    some = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    words, rows = pretokens.split(pa.array(some))
    found = [w.decode() for w in words.to_pylist()]
    for i, case in enumerate(some):
        assert found[rows[i] : rows[i + 1]] == regex.findall(public_tokenizers.PATTERN, case)


def test_bpe_query_against_the_library(spark):
    encode = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_edges(spark):
    encode = library()
    rows = spark.createDataFrame([(*c, 1) for c in cases()], "doc_id long, text string, block int").repartition(3)
    coded = bpe.encode(rows.persist(), MULTI)
    got = [(r.doc_id, r.ids, bytes(r.bytes)) for r in bpe.decode(coded.selectExpr("doc_id", "ids", "ids as kept"), MULTI).selectExpr("doc_id", "kept as ids", "bytes").collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(((d, encode(t or ""), (t or "").encode()) for d, t in cases()), key=key)
    assert bpe.encode(rows.where("false"), MULTI).count() == 0


def pieces_of(doc, text, tokenizer):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
    return [(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(FILE)
    key = lambda x: tuple(map(str, x))
    want = sorted((p for d, t in texts for p in pieces_of(d, t, tokenizer)), key=key)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= 1024
    lengths = np.array([p[3] for p in want])
    return len(held), packing.lower_bound(lengths, 1024) if len(lengths) else 0


def test_packing_query_against_the_library(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used, bound = check_packing(queries.op8_packing(spark, SF).collect(), texts)
    assert used <= 1.01 * bound + 1


@pytest.mark.parametrize("group", [20_000, 20])
def test_packing_edges(spark, group):
    rows = spark.createDataFrame([(*c, 1, 2) for c in cases()], "doc_id long, text string, open int, g int")
    used, bound = check_packing(packing.best_fit_packing(rows, FILE, group_items=group).collect(), cases())
    assert used <= 1.1 * bound + 2
    assert packing.best_fit_packing(rows.where("false"), FILE).count() == 0


def test_bound_and_best_fit():
    lengths = np.array([600, 600, 424, 424, 1000])
    bins = packing.best_fit(lengths, 1024)
    assert len(set(bins.tolist())) == 3 == packing.lower_bound(lengths, 1024)
