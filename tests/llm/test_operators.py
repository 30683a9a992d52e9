"""The operators against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from ripplemark.llm import bpe, decontam, jaccard, langid, output, pii, quality, rules, substrings, toxicity
from ripplemark.llm import words as W
from ripplemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
UP = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")

BASE = " ".join(f"w{i % 97}x{i % 31}" for i in range(120))
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "a b c d e",
    BASE,
    BASE,
    BASE.replace("w5x5", "changed"),
    BASE.upper(),
    "start " + BASE + " end of it",
    "x" * 5000,
    "mail a@b.c_d@e.f, 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 +12 ((((",
    "été  ünïcode x \x1c y z 'S don't 12345 " * 3,
    "1 2 3 4 5 6 7 8 9 " * 300,
    "line one\nline one\nline one\n\n other # $ % &",
    BASE + " " + BASE,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, "s", 1, "more") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk string")


def loop(texts):
    return enumerate(t or "" for t in texts)


def test_bpe(docs):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_bytes=2000), ranks).collect()}
    for k, t in loop(TEXTS):
        assert np.frombuffer(got[k].ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert bytes(got[k].decoded) == t.encode() and got[k].text == TEXTS[k] and got[k].chunk == "more"


def test_bpe_of_chunks_packed_anew(docs, monkeypatch):
    """Lists that don't fit the chunk they come back to are not used: all the ids are as before."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = {r.doc_id: bytes(r.ids) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    sent = bpe.encode_words
    # every second list has the checksum of another, and some are lost
    monkeypatch.setattr(bpe, "encode_words", lambda *a: sent(*a).filter("bucket % 3 <> 0").selectExpr("chunk", "bucket", "IF(bucket % 2 = 0, stamp + 1, stamp) AS stamp", "ids"))
    assert {r.doc_id: bytes(r.ids) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()} == whole


def test_decontamination(spark, docs):
    items = [(1, " ".join(BASE.split()[20:45])), (2, "ONE"), (3, None), (4, ""), (5, "c d"), (5, "c d"), (6, "never there at all")]
    got = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(UP))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for k, t in loop(TEXTS):
        w, hit, its = word.findall(t.translate(UP)), set(), set()
        for win, ids in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    its |= ids
        assert (got[k].n_words, sorted(got[k].hits), got[k]["items"]) == (len(w), sorted(hit), sorted(its))


def test_decontamination_in_blocks(spark, monkeypatch, tmp_path):
    """Blocks of a window: documents that match in every block, and repeated and null ids, keep their rows and hits."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(6)]
    dump = " ".join(t for _, t in items)
    rows = [(1, dump), (2, "nothing of it"), (3, items[4][1] + " more"), (3, items[4][1] + " more"), (3, "clean"), (None, items[2][1]), (None, "clean too"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted(((r.doc_id is None, r.doc_id, r.n_words, list(r.hits), list(r["items"]), r.n_hit, r.contaminated) for r in decontam.contamination(docs, bench).collect()), key=str)

    whole = found()
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 1)
    assert decontam.item_windows(bench).count() == 18 and found() == whole and len(whole) == len(rows)
    assert (False, 1, 90, list(range(90)), [str(k) for k in range(6)], 90, True) in whole
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 1 not in {r.doc_id for r in decontam.decontaminate(spark, docs, str(tmp_path)).collect()}


def sets_of(texts):
    out = []
    for _, t in loop(texts):
        w = SPACED.findall(t.translate(UP))
        out.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("part", "weight", "hot"), [(256, 500_000, True), (3, 500_000, True), (2, 500_000, False), (256, 300, True)])
def test_jaccard(spark, docs, monkeypatch, part, weight, hot):
    """Whole regions; cells, windows and blocks of few documents; without hot shingles; parts of few shingles."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "WEIGHT", weight)
    monkeypatch.setattr(jaccard, "HOT_SHINGLES", 1000 if hot else 0)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    rng = np.random.default_rng(1)
    texts = list(TEXTS)
    for k in range(40):
        w = BASE.split()
        for at in rng.integers(0, len(w), 2 + k % 3):
            w[at] = f"r{rng.integers(9)}"
        texts.append(" ".join(w[: rng.integers(80, 121)]))
    sets = sets_of(texts)
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == {k: (len(s), label[k]) for k, s in enumerate(sets)}


def test_jaccard_of_repeated_ids(spark, monkeypatch):
    """Rows of one doc_id are one document with the links of all its rows."""
    other = BASE.replace("w", "v")
    rows = [(3, BASE), (5, BASE), (5, other), (8, other + " v"), (9, "alone"), (9, "alone"), (10, BASE.replace("w", "u"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(3, 116, 3), (5, 116, 3), (8, 117, 3), (9, 1, 9), (10, 116, 10)}
    for copies in (jaccard.COPIES, 0):
        monkeypatch.setattr(jaccard, "COPIES", copies)
        assert {tuple(r) for r in jaccard.near_duplicates(df).collect()} == want


def test_output(spark, docs, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    path = f"file://{tmp_path}/orc"
    output.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), partitions=3)
    got = {r.doc_id: r for r in output.layout(spark, path).collect()}
    at = 0
    for k, t in loop(TEXTS):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        at += len(ids)
    assert output.read_tokens(spark, path, [5]).count() == 1


def test_word_ids_of_odd_signs():
    """Against the tokenizer: white space, controls, apostrophes, accents, marks, long s, digits."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    signs = "abcABZ019 \t\n\x0b\x1c\x85\xa0 '’s.,;<|>[]`{}~^_-+=*&#/É\u0338\u20d2\u0301ßÿÞøÆæŒœİıſKÅΣςσ中½²ªºµ×÷\u200bﬁ"
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(signs), rng.integers(0, 60))) for _ in range(3000)] + ["<|endoftext|>", "a<|startoftext|>b", "", " ", "don't 'S I'LL've x's.'re", "a" * 50000]
    got = output._WordIds(path).texts(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_output_of_added_tokens(spark, tmp_path):
    """Against the tokenizer as loaded: added tokens in a text, alone, within words, in capitals and cut short."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext", "<<|endoftext|>|>", "\u00e9<|endoftext|>\u0301 <| endoftext |>", "none of it", ""]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 997]
    output.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/orc", path, partitions=2)
    got = {r.doc_id: r for r in output.layout(spark, f"file://{tmp_path}/orc").collect()}
    at = 0
    for k, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(v - 9 * (v > 9) for k, c in enumerate(reversed(d)) for v in [int(c) * (1 + k % 2)]) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii(spark, docs):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] for r in pii.find_pii(docs).collect()}
    for k, t in loop(TEXTS):
        assert got[k] == [(n, m.start(), m.end()) for n in PATTERNS for m in re.finditer(PATTERNS[n], t) if valid(n, m.group(0))], k
    masked = {r.doc_id: r.text for r in pii.mask_pii(spark, docs, "").collect()}
    assert masked[5] == BASE and masked[0] is None and "[PHONE]" in masked[11] and "@" not in masked[11]


def test_pii_on_many_spans_and_clashing_names(spark):
    """Thousands of spans of all kinds in a text, against re; columns with the operator's names; no n_chars."""
    rng = np.random.default_rng(3)
    parts = ["a.b@c.de", "10.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "(743) 555-3824", "tok_0123456789abcdef0123456789", "été", "word", "x\ny"]
    long = " ".join(parts[k] for k in rng.integers(0, len(parts), 6000))
    rows = [(1, long, 1, "c"), (2, None, 2, "d"), (3, "call (743) 555-3824 or +1 (743) 555-3824", 3, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own int, spans string").selectExpr("*", "1 AS _c", "2 AS _d", "3 AS _text", "4 AS _k")
    got = {r.doc_id: r for r in pii.find_pii(df, name="found").collect()}
    want = [(n, m.start(), m.end()) for n in PATTERNS for m in re.finditer(PATTERNS[n], long) if valid(n, m.group(0))]
    assert [(s.kind, s.start, s.end) for s in got[1].found if s.kind in pii.BASE] == want and len(want) > 2000
    ends = [(s.start, s.end) for s in got[1].found if s.kind in pii.BASE]
    assert not any(a < s.end and s.start < b for s in got[1].found if s.kind not in pii.BASE for a, b in ends)
    assert all(long[s.start : s.end] == s.match for s in got[1].found)
    assert [(s.start, s.end) for s in got[3].found if s.kind == "phone"] == [(23, 40)] and not any(s.kind == "tel" and s.start > 20 for s in got[3].found)
    masked = {r.doc_id: r for r in pii.mask_pii(spark, df, "").collect()}
    assert (masked[2].text, masked[1]["_own"], masked[1].spans, masked[1]["_c"], masked[1]["_k"]) == (None, 1, "c", 1, 4)
    assert not re.search(PATTERNS["email"], masked[1].text) and masked[1].text.count("[EMAIL]") == long.count("@")


def test_reliabilities_and_classifier():
    """Expectation-maximisation on planted votes finds the labelers' reliabilities; the classifier follows the posteriors."""
    rng = np.random.default_rng(8)
    right, rows = {"regex": 0.9, "gazetteer": 0.8, "context": 0.7}, Counter()
    for _ in range(40_000):
        y = rng.random() < 0.4
        rows[("secret", *[(1 if y else -1) * (1 if rng.random() < p else -1) for p in right.values()], 3, y)] += 1
    table = Counter()
    for (*key, _), n in rows.items():
        table[tuple(key)] += n
    table = [dict(zip(("kind", *pii.LABELERS, "size", "n"), (*k, n), strict=True)) for k, n in sorted(table.items())]
    given, post = pii.reliabilities(table, rounds=300)
    for x, p in right.items():
        assert abs(given[x, 1][1] - p) < 0.05 and abs(given[x, 0][-1] - p) < 0.05
    truth = {k: rows[(*k, True)] / (rows[(*k, True)] + rows[(*k, False)]) for k in {r[:-1] for r in rows}}
    weights = pii.train(table, post, steps=2000)
    for r, p in zip(table, post, strict=True):
        key = (r["kind"], *[r[x] for x in pii.LABELERS], r["size"])
        z = sum(weights[k] for k in ("bias", "kind secret", "size 3", *[f"{x} {r[x]}" for x in pii.LABELERS]))
        assert abs(truth[key] - p) < 0.1 and abs(1 / (1 + np.exp(-z)) - p) < 0.1


def test_pii_recall_of_planted_spans(spark):
    """Of every kind nine in ten planted spans are found, also those that the votes decide on."""
    rng = np.random.default_rng(5)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    digits = lambda n: "".join(str(x) for x in rng.integers(2, 10, n))
    make = {"secret": lambda: f'api_key = "sk_{hexes(32)}"', "tel": lambda: f"call ({digits(3)}) {digits(3)}-{digits(4)} today", "email": lambda: f"mail {hexes(6)}@{hexes(5)}.org", "phone": lambda: f"tel +{digits(2)} {digits(3)} {digits(6)}", "ip": lambda: "host 10.1.2.3", "plain": lambda: "nothing in these words, version-1.2 and name_of_a_variable here"}
    kinds = [k for k in make for _ in range(60)]
    df = spark.createDataFrame([(n, f"some words before {make[k]()} and after it") for n, k in enumerate(kinds)], "doc_id long, text string")
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii.find_pii(df).collect()}
    for k in make:
        mine = [got[n] for n, x in enumerate(kinds) if x == k]
        assert sum(k in x for x in mine) >= 54 if k != "plain" else sum(map(bool, mine)) <= 6, k


@pytest.mark.parametrize(("hot", "share", "salts"), [(2000, 1000, 32), (0, 10**9, 2)])
def test_substrings(docs, monkeypatch, hot, share, salts):
    """As built, and with all anchors split by content and nearly all keys salted."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARE", share)
    monkeypatch.setattr(substrings, "SALTS", salts)
    words = [SPACED.findall(t) for _, t in loop(TEXTS)]
    first = {}
    for k, w in enumerate(words):
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), k)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    for k, w in enumerate(words):
        gone = {i for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < k for i in range(a, a + 50)}
        assert (got[k].n_words, got[k].n_removed, bytes(got[k].kept).decode()) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)), k


def test_rules(spark, docs):
    docs.createOrReplaceTempView("odd")
    rows = rules.ledger(docs).collect()
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        w = SPACED.findall(t)
        grams = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        twice = {i for a in range(len(w) - 2) if grams[tuple(w[a : a + 3])] > 1 for i in range(a, a + 3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
    kept = {r.rule: r for r in rules.ablations(rules.ledger(docs), "v2").collect()}
    assert kept["few_words"].n_failed == sum(r.n_words < 50 for r in rows)


def test_rules_on_clashing_names(spark):
    """Columns with the names of helpers are kept."""
    df = spark.createDataFrame([(1, "a b c a b c", 5, "x")], "doc_id long, text string, _own_words int, _body string").selectExpr("*", "7 AS _words", "8 AS _twice")
    r = rules.ledger(df).first()
    assert (r["_own_words"], r["_body"], r["_words"], r["_twice"], r.n_words, r.n_repeat_words) == (5, "x", 7, 8, 6, 6)


def test_word_vectors(spark, monkeypatch):
    """Known words and vectors against plain loops over words, when counts are handed on early and words are rarer than the vocabulary."""
    monkeypatch.setattr(quality, "COUNTED", 3)
    monkeypatch.setattr(quality, "VOCABULARY", 4)
    texts = ["the cat The dog ran", None, "a the", "", "cat the cat the 7up é", "alone", "b the cat dog"]
    found = quality.word_vectors(W.as_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    own = {}
    for t in texts:
        for w in (t or "").split():
            data = w.encode()
            own[w] = quality.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    number = {w: int(x.hash[0]) for w, x in own.items()}
    counts = Counter(number[w] for t in texts for w in (t or "").split())
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top = sorted(counts, key=lambda h: (-counts[h], signed(h)))[:4]
    assert found.known.tolist() == sorted(top)
    index = lambda h: quality.index_vectors(np.array([h], np.uint64))[0]
    near = {}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(w):
                    near.setdefault(number[w[i]], []).append(index(number[w[j]]))
                    near.setdefault(("shape", int(own[w[i]].shape[0])), []).append(index(number[w[j]]))
    for k, h in enumerate(sorted(top)):
        assert np.allclose(found.table[k], index(h) + np.mean(near[h], 0), atol=1e-5)
    for b in range(quality.SHAPES):
        at = index(int(W.mix(np.array([b], np.uint64))[0]))
        assert np.allclose(found.table[4 + b], at + (np.mean(near["shape", b], 0) if ("shape", b) in near else 0), atol=1e-5)
    data = "the rare rare".encode()
    got = quality.pooled(found, np.frombuffer(data, np.uint8), np.array([0, len(data), len(data)]))
    shapes = [4 + int(quality.words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).shape[0]) for x in (b"the", b"rare", b"rare")]
    mine = [sorted(top).index(number["the"]) if number["the"] in top else shapes[0], shapes[1], shapes[2]]
    assert np.allclose(got[0], [*found.table[mine].mean(0), *found.table[shapes].mean(0), 1 / 3, 11 / 3 / 8, np.log1p(3)], atol=1e-5)
    assert not got[1].any()


def test_mixtures():
    """Against all sets of languages, by brute force: shares of planted mixtures, and one language for texts of one."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.full(400, 0.3), 5) * 0.95 + 0.05 / 400
    logp = np.log(p)
    for planted in ([0], [3], [0, 1], [2, 4], [0, 2, 3]):
        counts = rng.multinomial(3000, p[planted].mean(0)).astype(float)
        use = np.flatnonzero(counts)
        share, score = langid.choose(logp[:, use], counts[use])
        best = {}
        for mask in range(1, 32):
            some = [k for k in range(5) if mask >> k & 1]
            w = np.full(len(some), 1 / len(some))
            for _ in range(400):
                w = w * (p[some] @ (counts / np.maximum(w @ p[some], 1e-300))) / counts.sum()
            best[tuple(some)] = counts[use] @ np.log(w @ p[some][:, use]) - langid.PENALTY * (len(some) - 1) * np.log(counts.sum() + 1)
        assert tuple(np.flatnonzero(share)) == max(best, key=best.get) == tuple(planted)
        assert np.abs(share[planted] - 1 / len(planted)).max() < 0.06 and 0 <= score <= 1


def test_models_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, int(k == 3)) for k in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    langs, logp = langid.fit(langid.trigram_counts(W.as_bytes(docs.filter("lang IS NOT NULL"), "doc_id", "text", "lang")))
    found = {r.doc_id: r for r in langid.identify(W.as_bytes(docs), langs, logp).collect()}
    digits = spark.createDataFrame([(1, "² ① 12"), (2, "Ⅷ 3"), (3, "x"), (4, "² é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in sorted(langid.identify(W.as_bytes(digits), langs, logp).collect())] == [True, True, False, False]
    assert found[0].lang_pred == "und" and found[2].score == 0 and found[5].lang_pred == "en"
    vectors, network = quality.fit(docs, quality.labelled(labels, "quality", 5, 0, 100))
    assert all(0 <= r.score <= 1 for r in quality.score(W.as_bytes(docs), vectors, network).collect())
    assert toxicity.toxicity(docs, docs, labels).count() == len(TEXTS)


def test_null_ids(spark, tmp_path):
    """Rows without an id are documents, and items, like others."""
    other, third = BASE.replace("w", "v"), BASE.replace("w", "u")
    rows = [(None, BASE), (7, BASE), (None, other), (None, other + " v"), (None, "some clean text"), (8, "more clean text"), (None, third), (9, third + " u"), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, at int")
    got = jaccard.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 7), (7, 7), (None, None), (None, None), (None, None), (8, 8), (None, 9), (9, 9), (None, None)], key=str)
    kept = jaccard.keep_first(spark, docs, "")
    at = {r["at"] for r in kept.collect()}
    assert kept.columns == docs.columns and len(at & {2, 3}) == 1 and at - {2, 3} == {1, 4, 5, 7, 8}
    n = {(r.doc_id, bytes(r.kept).decode()): r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert n[(7, BASE)] == n[(9, third + " u")] == n[(8, "more clean text")] == n[(None, "some clean text")] == 0
    whole = substrings.remove_repeats(docs).groupBy("doc_id").sum("n_removed").collect()
    assert {r[0]: r[1] for r in whole} == {7: 0, 8: 0, 9: 0, None: 360}
    items = spark.createDataFrame([(None, BASE), (3, third)], "item_id long, text string")
    found = sorted(((r.doc_id, r.n_hit, list(r["items"])) for r in decontam.contamination(docs, items).collect()), key=str)
    assert found == sorted([(None, 120, []), (7, 120, []), (None, 0, []), (None, 0, []), (None, 0, []), (8, 0, []), (None, 120, ["3"]), (9, 120, ["3"]), (None, 0, [])], key=str)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontam.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["at"] for r in clean.collect()} == {2, 3, 4, 5, 8}


def test_chain():
    """On planted rows: later models use the earlier ones' probabilities, words of clean rows don't count, and the whole is the models one by one."""
    rng = np.random.default_rng(2)
    toxic = (rng.random(600) < 0.3).astype(float)
    fold = rng.integers(0, toxicity.FOLDS, 600)
    words = np.array([3, 5, 9, 11], np.uint64)  # 3 and 5 mark toxic rows, 9 is anywhere, 11 marks one fold's only
    holds = np.stack([rng.random(600) < np.where(toxic == 1, p, q) for p, q in ((0.8, 0.01), (0.5, 0.01), (0.5, 0.5), (0.0, 0.0))], 1)
    holds[(toxic == 1) & (fold == 2), 3] = True
    row, col = np.nonzero(holds)
    bad, seen = (np.stack([(holds & ((fold == k) & ok)[:, None]).sum(0) for k in range(toxicity.FOLDS)], 1) for ok in (toxic == 1, toxic >= 0))
    chain = toxicity.Chain(row, col, words, toxic, fold, bad, seen)
    sets = [words[h] for h in holds] + [np.empty(0, np.uint64), np.array([7], np.uint64)]
    p = chain(sets)
    before = np.zeros((len(sets), 0))
    for m in chain.models:
        z = np.array([m.b + sum(m.w[list(words).index(w)] for w in s if w in words) + float(before[k] @ m.u) for k, s in enumerate(sets)])
        before = np.column_stack([before, 1 / (1 + np.exp(-z))])
    assert np.allclose(p, before) and [len(m.u) for m in chain.models] == [0, 1, 2]
    assert chain.models[0].w[2] == 0 and np.abs(chain.models[2].u).max() > 0.1
    marked = holds[:, :2].any(1)
    assert np.mean((p[:600, 2] >= 0.5)[(toxic == 1) & marked]) > 0.95 and np.mean((p[:600, 2] >= 0.5)[toxic == 0]) < 0.05 and p[-1, 2] == p[-2, 2] < 0.5


def test_marking_words_by_fold(spark):
    """fit() takes the words that mark the toxic rows of all folds, or of all but one, and no others; however many there are."""
    rng = np.random.default_rng(5)
    rows, toxic = [], {}
    for k in range(400):
        toxic[k] = int(k % 4 == 0)
        own = [f"zz{j}a" for j in range(30) if rng.random() < (0.4 if toxic[k] else 0.02 * (j % 7))]
        rows.append((k, " ".join([*own, *(f"plain{j}" for j in rng.integers(0, 50, 8))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(list(toxic.items()), "doc_id long, y int")
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {toxicity.FOLDS})").collect()}
    holds = {}
    for k, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        for h in toxicity._sets(data, np.array([0, len(data)]))[0].tolist():
            holds.setdefault(h, set()).add(k)
    want = set()
    for h, ids in holds.items():
        for without in range(-1, toxicity.FOLDS):
            bad, seen = sum(toxic[k] for k in ids if fold[k] != without), sum(fold[k] != without for k in ids)
            if bad >= max(toxicity.LEAST_ROWS, toxicity.LEAST_SHARE * sum(y for k, y in toxic.items() if fold[k] != without)) and bad >= toxicity.LEAST_PURITY * seen:
                want.add(h)
    chain = toxicity.fit(docs, train)
    assert chain.words.tolist() == sorted(want) and 5 < len(want) < len(holds)


def test_windows_of_many_items(spark, monkeypatch):
    """A window that all items have is one row of the index; each item is found all the same."""
    items = [(k, BASE) for k in range(300)] + [(None, BASE)]
    windows = decontam.numbered_windows(decontam.item_windows(spark.createDataFrame(items, "item_id long, text string")))
    assert windows.count() == len({tuple(BASE.split()[k : k + 13]) for k in range(len(BASE.split()) - 12)})
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 40)
    docs = spark.createDataFrame([(1, BASE), (1, BASE), (2, "none of it")], "doc_id long, text string")
    got = sorted((r.doc_id, len(r["items"]), r.n_hit) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    n = len(BASE.split())
    assert got == [(1, 300, n), (1, 300, n), (2, 0, 0)]


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, tmp_path, name):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    text = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    label = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = [r.lang_pred == text[r.doc_id].lang for r in QUERIES["op7_language_id"](spark, d).filter("held_out").collect()]
    assert np.mean(lang) > 0.95
    d = "/root/testdata/sf0.1"  # the smaller tables hold six toxic rows and eleven of low quality that are held out
    label = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    q = [(label[r.doc_id].quality, r.predicted) for r in QUERIES["op8_quality"](spark, d).filter("held_out").collect() if r.doc_id in label]
    assert min(np.mean([p == y for y, p in q if y == k]) for k in (0, 1)) >= 0.95
    t = [(label[r.doc_id].toxic, r.toxic) for r in QUERIES["op10_toxicity"](spark, d).filter("held_out").collect() if r.doc_id in label]
    assert np.mean([p for y, p in t if y]) >= 0.9 and np.mean([p for y, p in t if not y]) <= 0.01


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count() < docs.count()
    one = out.first()
    assert hashlib.sha256(one.text.encode()).hexdigest() == one.decoded_sha256


def test_sql_of_rules(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    q = c.sql(rules.OP9_SQL)
    assert {tuple(r) for r in q.fetchall()} == {tuple(r) for r in QUERIES["op9_quality_rules"](spark, DATA).select(*q.columns).collect()}


def test_stages_keep_columns_of_any_names(spark, tmp_path):
    """Columns named like the stages' own, repeated rows, null ids and an empty table."""
    rows = [(1, BASE, 77, b"a", "x"), (2, BASE, 88, b"b", "y"), (3, "one two three", 99, None, None), (3, "one two three", 99, None, None), (None, "quite another text", 5, b"c", "z")]
    shape = "doc_id long, text string, row_key int, ids binary, decoded string"
    df = spark.createDataFrame(rows, shape)
    spark.createDataFrame([(1, "never there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, want in ((jaccard.keep_first, [77, 99, 99, 5]), (decontam.decontaminate, [77, 88, 99, 99, 5]), (pii.mask_pii, [77, 88, 99, 99, 5]), (bpe.tokenise, [77, 88, 99, 99, 5])):
        got = stage(spark, df, str(tmp_path))
        assert got.columns[:5] == df.columns or set(df.columns) <= set(got.columns)
        assert sorted(r.row_key for r in got.collect()) == sorted(want), stage
        assert {r.row_key: (None if r.ids is None else bytes(r.ids), r.decoded) for r in got.collect()}[77] == (b"a", "x")
        assert stage(spark, spark.createDataFrame([], shape), str(tmp_path)).count() == 0


def test_masking_many_spans(spark):
    """Twenty thousand spans in one text, and spans at and over the ends of its pieces."""
    text = "é mail a.b@c.de " * 20_000
    edge = "x" * (pii.PIECE - 4) + " a.b@c.de " + "y" * (2 * pii.PIECE - 7) + " 10.2.3.4"
    docs = spark.createDataFrame([(1, text), (2, edge), (3, "10.2.3.4"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask_pii(spark, docs, "").collect()}
    assert got[1] == "é mail [EMAIL] " * 20_000 and got[2] == edge.replace("a.b@c.de", "[EMAIL]").replace("10.2.3.4", "[IP]")
    assert (got[3], got[4], got[5]) == ("[IP]", None, "")
