"""Language identification by multilingual mixtures.

Each language is a distribution over letter trigrams, counted over all training documents.  For a
document, expectation-maximisation estimates the proportions of the languages in it; the language
set is the one of highest penalised likelihood among the best single language, all languages with
a share, and the sets left when those of the smallest share are dropped one after the other (a
mixture must beat the best single language by its parameters' cost).

Null texts and texts without letters are `und` with score 0.  Rows with null lang do not train;
with nothing to learn from, every text is `und`.  Repeated documents each get their row, also those
without doc_id, which do not train and for which the query's `held_out` is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: A language is in the set only with this share of the text at least.
LEAST_SHARE = 0.05
#: Cost of a further language in the set, in units of log(number of trigrams).
PENALTY = 2.0

_FOLD = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if _b >= 0x80 or 0x61 <= _b <= 0x7A:
        _FOLD[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 0x20


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams that hold a letter, and the text number of each."""
    d = _FOLD[data].astype(np.uint32)
    if len(d) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    use = (x != 0x202020) & (owner[:-2] == owner[2:])
    return ((x[use] * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64), owner[:-2][use]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, slot, n) over all rows of (doc_id, text, lang)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(2).to_pylist(), object)
            for lo, hi, data, offs in W.slices(b.column(1)):
                slot, owner = _trigrams(data, offs)
                for lang in set(langs[lo:hi]):
                    mine = (langs[lo:hi] == lang)[owner]
                    total[lang] = total.get(lang, 0) + np.bincount(slot[mine], minlength=SLOTS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "slot", "n"])

    return docs.mapInArrow(W.tidy(each), "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed log-probabilities; languages x SLOTS numbers come to the driver."""
    table = counts.toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    langs = sorted(set(lang))
    n = np.full((len(langs), SLOTS), 0.5)
    for k, x in enumerate(langs):
        mine = lang == x
        n[k, table.column("slot").to_numpy()[mine]] += table.column("n").to_numpy()[mine]
    return langs, np.log(n / n.sum(1, keepdims=True))


def mixture(logp: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of logp) in a text and its log-likelihood, by EM."""
    top = logp.max(0)
    p = np.exp(logp - top)
    share = np.full(len(logp), 1 / len(logp))
    total = counts.sum()
    for _ in range(rounds):
        old, share = share, share * (p @ (counts / (share @ p))) / total
        if np.abs(share - old).max() < 1e-3:
            break
    return share, float(counts @ (np.log(share @ p) + top))


def choose(logp: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Each language's share under the set of highest penalised likelihood, and the winner's score."""
    alone = logp @ counts
    best = int(alone.argmax())
    share = np.zeros(len(logp))
    share[best] = 1
    if len(logp) > 1:
        some = np.flatnonzero(mixture(logp, counts)[0] >= LEAST_SHARE)
        found, most = None, 0.0
        while len(some) > 1:
            parts, fit_ = mixture(logp[some], counts)
            gain = fit_ - alone[best] - PENALTY * (len(some) - 1) * np.log(counts.sum() + 1)
            if gain > most:
                found, most = (some, parts), gain
            some = np.delete(some, parts.argmin())
        if found is not None:
            share[best] = 0
            share[found[0]] = found[1]
            return share, float(share.max())
    return share, float(1 / np.exp(np.maximum(alone - alone[best], -700)).sum())


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, shares) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for b in batches:
            texts = b.column(1)
            out: list[tuple[str, float, list]] = []
            for lo, hi, data, offs in W.slices(texts):
                slot, owner = _trigrams(data, offs)
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    u, c = np.unique(slot[at[k] : at[k + 1]], return_counts=True)
                    if not langs or not any(map(str.isalpha, data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))):
                        out.append(("und", 0.0, []))
                        continue
                    share, score = choose(logp[:, u], c.astype(float)) if len(u) else (np.full(len(langs), 1 / len(langs)), 1 / len(langs))
                    out.append((langs[int(share.argmax())], min(1.0, score), [(x, float(s)) for x, s in zip(langs, share, strict=True) if s > 0]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], schema.field(i + 1).type) for i in range(3)]], schema=schema)

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, lang_pred string, score double, shares map<string,double>")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's language, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.filter((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    langs, logp = fit(trigram_counts(W.as_bytes(train, "doc_id", "text", "lang")))
    found = identify(W.as_bytes(docs), langs, logp)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
