"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A word here is what stands between two single spaces that have no white space beside them, with
the space before it: the tokenizer's pattern always breaks there, so each word is encoded on its
own, by the tokenizer library, once in the whole corpus.

Texts are packed into chunks of about CHUNK_BYTES, compressed.  A chunk is exploded into its
distinct words, which are dealt by their hash into buckets; the global shuffle by bucket brings
equal words together, each distinct word is encoded once, and the ids go back to the chunks that
use the word; each chunk then puts its texts together again by position.  Shuffled are the texts
once, and each chunk's distinct words there and ids back, as compressed lists, not every
occurrence.  Each list goes with its checksum: where a chunk was packed anew after an executor was
lost, with other rows, its words are encoded by the chunk itself.  Decoding joins ids with the token-byte table (as many rows as the vocabulary).

Null texts count as empty and have no ids.  Repeated rows are encoded each; further columns are
kept, but for one named like the output.  A word of any length is encoded whole.  The output
`ids` is binary: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .names import free_prefix

CHUNK_BYTES = 5_000_000

#: A space beside which white space or an end of the text stands: the text isn't split plainly.
_ODD = re.compile(r"(?:^|\s) | (?:\s|$)")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def split_words(text: str) -> list[str]:
    """The text's words: the first as it is, the rest without the one space before them."""
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, payload): the rows in chunks of about chunk_bytes, as compressed Arrow streams.

    A chunk's number is made of its task's number and its place in the task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

        def packed() -> pa.RecordBatch:
            nonlocal task
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            task += 1
            return pa.RecordBatch.from_arrays([pa.array([task - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= chunk_bytes:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(W.tidy(each), "chunk bigint, payload binary")


def _texts(payload: bytes, text: str) -> tuple[pa.Table, list[str | None]]:
    table = pa.ipc.open_stream(payload).read_all()
    return table, table.column(text).to_pylist()


def _dealt(texts: list[str | None], buckets: int) -> list[list[str]]:
    """The distinct words by bucket, each in order; a first word has a line feed before it."""
    found: set[str] = set()
    for t in texts:
        if t:
            parts = split_words(t)
            found.add("\n" + parts[0])
            found.update(parts[1:])
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in sorted(found):
        out[zlib.crc32(w.encode()) % buckets].append(w)
    return out


def _stamp(words: list[str]) -> int:
    """A checksum of a list of words and their order."""
    return zlib.crc32("\0".join(words).encode())


def distinct_words(chunks: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, chunk, stamp, words): each chunk's distinct words, as compressed lists by bucket, and the lists' checksums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for chunk, payload in zip(b.column(0), b.column(1), strict=True):
                lists = _dealt(_texts(payload.as_py(), text)[1], buckets)
                some = [k for k, x in enumerate(lists) if x]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk.as_py()] * len(some), pa.int64()), pa.array([_stamp(lists[k]) for k in some], pa.int64()), pa.array([squeeze("\0".join([f"{len(w)}:{w}" for w in lists[k]]).encode()) for k in some], pa.binary())], ["bucket", "chunk", "stamp", "words"])

    return chunks.mapInArrow(W.tidy(each), "bucket int, chunk bigint, stamp bigint, words binary")


def _listed(blob: bytes) -> list[str]:
    """The words of a list, each after its length, as a word may hold any sign."""
    import zstandard

    data, out, at = zstandard.ZstdDecompressor().decompress(blob).decode(), [], 0
    while at < len(data):
        colon = data.index(":", at)
        end = colon + 1 + int(data[at:colon])
        out.append(data[colon + 1 : end])
        at = end + 1
    return out


def _ids_of(encode, word: str) -> bytes:
    """The ids of a word of _dealt()."""
    return np.array(encode(word[1:] if word[:1] == "\n" else " " + word), "<u4").tobytes()


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(chunk, bucket, stamp, ids): the ids of each list's words; within a bucket each word is encoded once.

    A task holds the words of its buckets: a fixed part of the corpus's distinct words.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        known: dict[str, bytes] = {}
        for b in batches:
            out = []
            for blob in b.column(3):
                ids = []
                for w in _listed(blob.as_py()):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = _ids_of(encode, w)
                    ids.append(got)
                out.append(squeeze(np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(out, pa.binary())], ["chunk", "bucket", "stamp", "ids"])

    return words.mapInArrow(W.tidy(each), "chunk bigint, bucket int, stamp bigint, ids binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents with `ids`."""
    spark = docs.sparkSession
    W.small_batches(spark)
    docs = docs.drop("ids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = pack(docs, chunk_bytes).repartition(buckets, "chunk")
    words = distinct_words(chunks, buckets, text).repartition(buckets, "bucket")
    back = encode_words(words, ranks, pattern)
    schema = docs.withColumn("ids", F.lit(b"")).schema
    names = docs.columns
    shared = spark.sparkContext.broadcast(ranks)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        table, texts = _texts(left.column("payload")[0].as_py(), text)
        lists = _dealt(texts, buckets)
        ids: dict[str, bytes] = {}
        for k, stamp, blob in zip(right.column("bucket").to_pylist(), right.column("stamp").to_pylist(), right.column("ids"), strict=True):
            if stamp != _stamp(lists[k]):
                continue
            data = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n = len(lists[k])
            ends = (np.cumsum(np.frombuffer(data, "<u4", n)) * 4 + 4 * n).tolist()
            at = 4 * n
            for w, end in zip(lists[k], ends, strict=True):
                ids[w] = data[at:end]
                at = end
        # a chunk that was packed anew, from rows in another order, may have lists that no ids were sent for
        lost = [w for x in lists for w in x if w not in ids] if len(ids) < sum(map(len, lists)) else []
        if lost:
            encode = _encoder(shared.value, pattern).encode_ordinary
            ids |= {w: _ids_of(encode, w) for w in lost}
        out = []
        for t in texts:
            if t:
                parts = split_words(t)
                parts[0] = "\n" + parts[0]
                out.append(b"".join(map(ids.__getitem__, parts)))
            else:
                out.append(b"")
        done = table.rename_columns(names).append_column("ids", pa.array(out, pa.binary()))
        del ids, lists, texts, out
        W.release()
        return done

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(join, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids, joined from the token-byte table."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    ends = np.cumsum([len(t) for t in table])
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), ends - [len(t) for t in table], np.array([len(t) for t in table])))
    schema = encoded.drop(into).select("*", F.lit(b"").alias(into)).schema
    at = [c for c in encoded.columns if c != into]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = shared.value
        for b in batches:
            b = b.select(at)
            out = []
            for x in b.column(at.index(ids)):
                i = np.frombuffer(x.as_py() or b"", "<u4")
                n = sizes[i]
                out.append(data[np.repeat(starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*at, into])

    return encoded.mapInArrow(W.tidy(each), schema)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and the hashes of their ids and of the bytes decoded from them."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = free_prefix(docs)
    kept = {c: f"{own}{k}" for k, c in enumerate(docs.columns) if c.lower() in ("ids", "decoded")}  # a caller's columns of these names stay
    done = decode(encode(docs.withColumnsRenamed(kept), ranks, public_tokenizers.PATTERN), ranks)
    done = done.withColumns({"n_tokens": (F.length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")
    return done.withColumnsRenamed({new: c for c, new in kept.items()})


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: ids and their decoding for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenise(spark, docs, sf_dir).drop("text")
