"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id.

`write_tokens` sorts the documents by doc_id into ranges, encodes each range's texts in order and
writes one ORC file a range; ids are an array of int, which ORC's integer run-length encoding
packs, and the writer keeps a row index and a Bloom filter of doc_id for each group of rows, so
that `read_tokens` of single documents skips stripes and row groups.  Stripes are read in
parallel.  `layout` finds where each document's ids start in the whole corpus, from the files.

Ids are those of the tokenizer as its file is loaded, so an added token's string in a text is that
token.  Null texts count as empty: their row holds the end id alone.  Rows with equal doc_id keep all
their ids, in an order that their text decides.  An empty table writes no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

END_ID = 2
#: Words whose ids a Python worker keeps at once; when full, they are dropped and found anew.
CACHE_WORDS = 600_000
#: Words given to the tokenizer in one text.
_JOINED = 4000

#: Signs that splitting takes for white space and the tokenizer doesn't, and marks that may
#: combine with the letter before them; texts with one are encoded as a whole.
_ODD = "[\x1c-\x1f\u0300-\u036f]"

#: A sign after a letter or digit begins a token (but for an apostrophe); set apart from what is
#: before, it leaves fewer distinct words.
_LETTERS = "a-zÀ-ÖØ-öø-ÿ"
_MARK = rf"([{_LETTERS}0-9])([!-&(-/:-@\[-`{{-~])"

#: Words of these letters are one token each before merging.
_PLAIN = re.compile(f"[{_LETTERS}]+")

#: The character that byte-level BPE writes for each byte of those letters that has a name of its own.
_BYTE_CHARS = {x: chr(290 + x - 0x80) for x in range(0x80, 0xA1)} | {0xAD: chr(323)}

_cache: dict[str, dict[str, bytes]] = {}


def _quoted(text: str) -> str:
    """A pattern of the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII)


class _WordIds:
    """Ids of words between white space; each distinct word is encoded once a batch at most.

    The tokenizer reads white space of any length as a break between words and ignores case, so a
    text's ids are its words' ids.  Runs of words are encoded together: words of plain letters
    by the merges alone and cut apart at the tokens that end words, others by the whole tokenizer
    and cut apart by their character offsets.  Added tokens are read as text; with `added`, they
    are what the tokenizer file makes of them: texts that hold one's string are encoded as a whole.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.whole, self.odd = self.tokenizer, _ODD
        if added:
            self.whole = Tokenizer.from_file(path)
            self.odd = "|".join([_ODD, *(f"(?i:{_quoted(t.content)})" for t in self.whole.get_added_tokens_decoder().values())])
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known = _cache.setdefault(path, {"": b""})

    def texts(self, texts: pa.Array) -> list[bytes]:
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), _MARK, r"\1 \2")
        lists = pc.utf8_split_whitespace(apart)
        found = lists.flatten().dictionary_encode()
        words, codes = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.known[""] = b""
        self._learn([w for w in words if w not in self.known])
        parts = [self.known[w] for w in words]
        pool, size = np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
        n = size[codes]
        done = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.repeat((np.cumsum(size) - size)[codes] - done[:-1], n) + np.arange(done[-1])]
        edges = done[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        out = [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k in odd:
            out[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _learn(self, words: list[str]) -> None:
        plain = sorted((w for w in words if _PLAIN.fullmatch(w)), key=str.isascii)
        other = [w for w in words if not _PLAIN.fullmatch(w)]
        for k in range(0, len(plain), _JOINED):
            some = plain[k : k + _JOINED]
            joined = " ".join(some).lower()
            if not joined.isascii():
                joined = joined.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            self._keep(some, ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]))
        for k in range(0, len(other), _JOINED):
            some = other[k : k + _JOINED]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.array([a for a, _ in found.offsets], np.int64)
            self._keep(some, np.array(found.ids, "<u4"), np.searchsorted(first, np.cumsum([0, *[len(w) + 1 for w in some]])))

    def _keep(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        blob, cuts = ids.tobytes(), (cuts * 4).tolist()
        self.known.update((w, blob[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """ORC files of (doc_id, n_tokens, ids) in ascending doc_id order."""
    spark = docs.sparkSession
    W.small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordIds(tokenizer, added=True)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            got = [x + end for x in words.texts(b.column(1))]
            size = np.array([len(x) // 4 for x in got], np.int64)
            flat = pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), ids], ["doc_id", "n_tokens", "ids"])

    rows = ordered.mapInArrow(W.tidy(each), "doc_id bigint, n_tokens bigint, ids array<int>")
    rows.write.option("orc.compress", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20)).orc(path)


_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; of some documents only, if their ids are given (pruned by metadata)."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, start counting all ids before it.

    A file's total is one row, so only file totals are summed up in one place; within a file the
    running sum goes by its own rows.
    """
    rows = read_tokens(spark, path).withColumn("file", F.input_file_name())
    totals = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("first", "file")) - F.col("total")).alias("before"))
    own = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat, offs = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "crc"])

    each = rows.mapInArrow(check, "doc_id bigint, n_tokens bigint, file string, crc bigint")
    return each.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("start"), "n_tokens", "crc")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's place and checksum, read back from the ORC files."""
    import public_tokenizers

    path = W.shared_dir(spark) + "-orc"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return layout(spark, path).withColumnRenamed("crc", "ids_crc32")
