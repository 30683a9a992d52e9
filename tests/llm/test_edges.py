"""Very long texts, repeated rows, a row without an id, and columns with the operators' own names."""

import hashlib
from collections import Counter

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from ripplemark.llm import bpe  # noqa: E402
from ripplemark.llm.bpe import tokenise  # noqa: E402
from ripplemark.llm.pii import mask_pii  # noqa: E402
from ripplemark.llm.queries import QUERIES  # noqa: E402
from ripplemark.llm.toxicity import keep_clean  # noqa: E402

BASE = " ".join(f"w{i % 97}x{i % 31}" for i in range(120))
LONG = " ".join(f"n{k}" for k in range(60_000)) + " " + BASE
ITEM = " ".join(BASE.split()[20:45])
ROWS = [(1, LONG), (1, LONG), (2, BASE), (2, BASE), (3, "a clean text"), (None, BASE)]
#: Names that the operators use for columns of their own.
NAMES = ["row_key", "ids", "decoded", "hits", "items", "words", "n_words", "n_hit", "spans", "n", "n_shingles", "component_id", "region", "chunk", "slot", "kept"]


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("edges"))
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in NAMES)
    spark.createDataFrame([(k, t, "en", "s", len(t), *range(len(NAMES))) for k, t in ROWS], columns).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "absent")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def found(spark, folder: str, name: str, *columns: str) -> Counter:
    return Counter(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def test_bpe(spark, folder):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {t: enc.encode_ordinary(t) for _, t in ROWS}
    want = Counter((k, len(ids[t]), sha(b"".join(x.to_bytes(4, "little") for x in ids[t])), sha(t.encode())) for k, t in ROWS)
    assert found(spark, folder, "op1_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_decontamination(spark, folder):
    want = Counter((k, len(t.split()), 25 * (ITEM in t), int(ITEM in t), sha(b"1" if ITEM in t else b""), t == BASE) for k, t in ROWS)
    assert found(spark, folder, "op2_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_jaccard(spark, folder):
    want = {(1, 60_116, 1): 1, (2, 116, 2): 1, (3, 1, 3): 1, (None, 116, 2): 1}
    assert found(spark, folder, "op3_jaccard", "doc_id", "n_shingles", "component_id") == want


def test_substrings(spark, folder):
    """All of BASE stands at the end of the first document; a document's own other row is no earlier one."""
    want = Counter((k, len(t.split()), 120 * (t == BASE), sha(b"" if t == BASE else t.encode())) for k, t in ROWS)
    assert found(spark, folder, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_rules(spark, folder):
    want = Counter((k, len(t.split()), sum(map(len, t.split())), 0, 0, 0, len(t.split()) < 50) for k, t in ROWS)
    assert found(spark, folder, "op9_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


@pytest.fixture(scope="module")
def labels(spark, folder):
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize(("name", "columns"), [("op7_language_id", ("lang_pred", "score")), ("op8_quality", ("score", "predicted")), ("op10_toxicity", ("p_toxic", "toxic"))])
def test_models(spark, labels, name, columns):
    """Each row is judged, equal texts alike; without an id `held_out` is null."""
    got = QUERIES[name](spark, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ROWS)
    assert all((r.held_out is None) == (r.doc_id is None) for r in got)
    text = dict(ROWS)
    assert len({(text[r.doc_id], *(r[c] for c in columns)) for r in got}) == len({t for _, t in ROWS})


def test_output(spark, folder):
    """Repeated rows follow one another; a row without an id comes somewhere, and no id is lost."""
    got = QUERIES["op4_token_output"](spark, folder).collect()
    size = {}
    for r in got:
        size.setdefault(r.doc_id, set()).add(r.n_tokens)
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ROWS) and all(len(n) == 1 for n in size.values()) and size[None] == size[2]
    end = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens


def test_stages(spark, labels):
    """Very long, repeated and id-less rows and columns of any names through the stages: what is kept is kept whole."""
    docs = spark.read.parquet(f"{labels}/documents.parquet")
    for stage in (keep_clean, mask_pii, tokenise):
        out = stage(spark, docs, labels)
        assert out.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(out.columns)
        kept = Counter((r.doc_id, r.text, *(r[c] for c in NAMES)) for r in out.collect())
        assert kept <= Counter((k, t, *range(len(NAMES))) for k, t in ROWS) and (stage is keep_clean or sum(kept.values()) == len(ROWS))
