"""The trie of conversation prefixes against plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ripplemark.llm import prefixes as P

DATA = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string, bytes int, key string"


def rebuilt(rows):
    """conv_id -> its turns, by the query's rule."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not children[n]
    out = []
    for n, m in members.items():
        at_end = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(n)))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(at_end.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


RULE = (lambda c: c - c % 5, lambda c: P.F.crc32(c.cast("string").cast("binary")) % 9, 8)


def made(seed=3, n=60):
    """Conversations with shared starts, exact copies, long ones, nulls, ties and a missing base."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c == 20:
            continue
        kind = rng.random()
        words = ["a", "b", "é ü", None, ""] if kind < 0.7 else [f"own {c} {k}" for k in range(3)]
        for t in range(rng.choice([1, 2, 3, 9, 14, 40])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "assistant", None]) if kind < 0.4 else "user", rng.choice(words), 1, "x"))
    for c in range(100, 130):  # copies
        rows += [(c, t, "user", f"copy {t}", 1, "x") for t in range(12)]
    rows += [(None, 1, "user", "no conversation", 1, "x"), (7, 2, "user", "b", 1, "x"), (7, 2, "user", "b", 1, "x"), (10**12, 0, "user", "far", 1, "x")]
    return rows


@pytest.mark.parametrize("bits", [28, 3])  # a sketch of 8 cells proves nearly nothing, and gives the same nodes
def test_nodes(spark, monkeypatch, bits):
    rows = made()
    # ties stand by role and digest: give them one text here, as the loop orders them by text
    df = spark.createDataFrame(rows, SHAPE)
    monkeypatch.setattr(P, "MOST_BITS", bits)
    monkeypatch.setattr(P, "END_RANGE", 7)
    assert got(P.prefix_trie(df, *RULE)) == brute(rebuilt(rows))


def test_conversations_as_they_are(spark):
    rows = made(9, 40)
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got(P.prefix_trie(spark.createDataFrame(rows, SHAPE))) == brute({c: [x[2:] for x in sorted(t)] for c, t in own.items()})


def test_empty_and_long(spark):
    assert P.prefix_trie(spark.createDataFrame([], SHAPE), *RULE).count() == 0
    text = "word " * 100_000
    rows = [(c, t, "user", text, 1, "x") for c in (5, 6) for t in range(2)] + [(3, t, "user", str(t % 2), 1, "x") for t in range(2000)]
    convs = rebuilt(rows)
    nodes = {r[:2]: r for r in got(P.prefix_trie(spark.createDataFrame(rows, SHAPE), *RULE))}
    assert len(nodes) == len({tuple(t[:d]) for c, t in convs.items() for d in (range(len(t) + 1) if c != 3 else [0])}) + len(convs[3])
    assert nodes[(3, len(convs[3]))][3:7] == (1, 0, 1, 0)


def test_a_key_estimated_at_one_is_single(spark):
    keys = [hashlib.blake2b(str(k % 300).encode(), digest_size=16).digest() for k in range(400)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").repartition(5)
    parts = {r.part: r.twice for r in P.sketch(df, 10).collect()}
    held = Counter(keys)
    rows, block = P.ROWS, 1 << 10
    for key, n in held.items():
        cells = P._cells(P.pa.array([key], P.pa.binary()), 10)
        bits = [bool(r in parts and parts[r][c[0] >> 3] >> (7 - (c[0] & 7)) & 1) for r, c in enumerate(cells)]
        assert n == 1 or all(bits)
    assert rows * block // 8 >= sum(map(len, parts.values())) and any(not b for b in bits)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(P.op12_prefix_trie(spark, DATA)) == brute(rebuilt(rows))
