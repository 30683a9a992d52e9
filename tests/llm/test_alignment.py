"""Alignment of two tokenizers against plain loops with the libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ripplemark.llm import alignment as A

DATA = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    "one",
    "The quick brown fox's 12345 jumps\n\n  over\tthe lazy dog. " * 3,
    "The quick brown fox's 12345 jumps\n\n  over\tthe lazy dog. " * 3,
    "été ünïcode 中文字符 😀 \x1c\x00 end",
    "a ▁ b",  # the model's own sign for a space: not given back
    "say <|endoftext|> and </s> <unk> here",
    "x" * 20_000,
    "word " * 30_000,
    "   lead and trail   ",
]


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, byte by byte."""
    ta = Tokenizer.from_file(PATHS[0])
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    ba, bb = A.bytes_a(PATHS[0]), A.bytes_b(PATHS[1])
    done, pairs = [], Counter()
    for t in texts:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        if t and not (b"".join(ba[x] for x in a) == b"".join(bb[x] for x in b) == (" " + t).encode()):
            a, b = [], []
        i = j = 0
        ea, eb = len(ba[a[0]]) if a else 0, len(bb[b[0]]) if b else 0
        own, groups, ga, gb = [], [], [], []
        while i < len(a) and j < len(b):
            own.append((a[i], b[j]))
            if i not in ga:
                ga.append(i)
            if j not in gb:
                gb.append(j)
            if ea == eb:
                groups.append(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[x]) for x in gb))
                ga, gb = [], []
            step_a, step_b = ea <= eb, eb <= ea
            if step_a:
                i += 1
                ea += len(ba[a[i]]) if i < len(a) else 0
            if step_b:
                j += 1
                eb += len(bb[b[j]]) if j < len(b) else 0
        pairs.update(own)
        done.append((a, b, own, groups))
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return [(len(a), len(b), len(g), len(own), sum(pairs[p] == top[p[1]] for p in own), sum(pairs[p] for p in own), ";".join(g)) for a, b, own, g in done]


@pytest.mark.parametrize("few", [False, True])
def test_alignment(spark, monkeypatch, few):
    if few:  # several levels of the tree, lists of few pairs, a pass for each few buckets
        for name, n in (("FAN", 2), ("HELD", 20), ("SLICE", 30), ("TEXTS", 100)):
            monkeypatch.setattr(A, name, n)
    rows = [(k, t, 5, "k", [1.5]) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, keys string, b array<double>").repartition(6)
    got = A.align(df, *PATHS)
    assert got.columns == ["doc_id", "text", "keys", "b", *A.OUT]
    found = {r.doc_id: tuple(r) for r in got.collect()}
    for k, want in enumerate(brute(TEXTS)):
        assert found[k][4:] == want, k
        assert found[k][1:4] == (TEXTS[k], "k", [1.5])


def test_no_rows_and_no_tokens(spark):
    shape = "doc_id long, text string"
    assert A.align(spark.createDataFrame([], shape), *PATHS).count() == 0
    assert [tuple(r) for r in A.align(spark.createDataFrame([(1, None), (None, "")], shape), *PATHS, keep=["doc_id"]).orderBy("doc_id").collect()] == [(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_ids_in_rank_order_are_those_of_the_library():
    ranks = A._in_rank_order(PATHS[0])
    assert ranks and len(ranks) == 50_256
    tokenizer = Tokenizer.from_file(PATHS[0])
    tokenizer.encode_special_tokens = True
    for t, ids in zip(TEXTS[1:], A.encoder_a(PATHS[0])(TEXTS[1:])):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert A._in_rank_order(public_tokenizers.path("word_bpe_49k.json")) is None


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        h = A.PerfectHash.load(A.PerfectHash.build(keys).dump())
        assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    placed = np.empty_like(keys)
    placed[h.find(keys)] = keys
    table = A.Counts([(k, h.dump(), placed.tobytes(), np.ones(len(keys), "<i8").tobytes(), np.ones(len(keys), bool).tobytes()) for k in range(A.BUCKETS)])
    count, best = table.find(np.append(keys[:5], np.uint64(2**63)), 32_000)
    assert count.tolist() == [1] * 5 + [0] and best.tolist() == [True] * 5 + [False]


def test_query(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in A.op13_alignment(spark, DATA).collect()}
    for k, want in zip(texts, brute(texts.values())):
        assert got[k] == (*want[:-1], hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else ""), k
