"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates come from patterns: four base kinds (email, ip, card, phone), which always stay when
they pass their own checks, and two further kinds (secret, tel) that the method decides on.  Three
labelers vote on every candidate: `regex` (strict form of the kind), `gazetteer` (a cue word of
the kind stands close before it) and `context` (quotes, assignment signs and separators around
it).  Votes are counted by pattern over the whole corpus; expectation-maximisation on that small
table (at most kinds x 27 x shapes rows) estimates each labeler's reliability, and its posteriors
train a logistic span classifier, which is applied as a column expression.

Null or empty texts have no spans.  Spans are in code points, end exclusive.  Repeated documents
each get their spans; further columns are kept, whatever their names, but for the one that the
result is asked to have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_prefix

# Each pattern finds the same matches as the plain form of the kind (leftmost, not overlapping),
# written so that it can neither backtrack over long runs nor start in the middle of one.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "secret": "(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
    "tel": "(?<![0-9+)-])(?<!\\+[0-9]{1,3}[\\x20.-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: A text without this sign holds no match of the kind.
_SIGN = {"email": "@", "phone": "+"}
KINDS = list(PATTERNS)
BASE = KINDS[:4]

#: Cue words that stand before personal data, in the languages served.
CUES = {
    "email": "mail|email|e-mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|address|addr|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta|iban|account",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "secret": "token|key|secret|password|passwd|api|auth|bearer",
    "tel": "phone|tel|call|mobile|fax|telefon|telefono",
}
STRICT = {
    "email": f"^{_LOCAL}{{1,64}}@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$",
    "ip": "^(?:[1-9][0-9]{0,2})(?:\\.[0-9]{1,3}){3}$",
    "card": "^[3-6][0-9]{3}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$",
    "phone": "^\\+[1-9][0-9]{0,2}[ .-]?\\(?[0-9]{1,4}\\)?[ .0-9-]{5,}$",
    "secret": "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_]{24,}$",
    "tel": "^\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}$",
}
BEFORE, AFTER = 24, 2
_FAR = (1 << 31) - 1


_SPAN = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"


def _running(a: Column, op, zero: int) -> Column:
    """Running results of an associative op over an array of ints: n steps, in blocks, as arrays grow by copying."""
    none = F.array().cast("array<int>")
    n = F.size(a)
    block = F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))

    def within(b: Column) -> Column:
        return F.aggregate(F.slice(a, b * block + 1, block), F.struct(F.lit(zero).alias("at"), none.alias("out")), lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(op(s["at"], x))).alias("out")))["out"]

    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), within)
    # each block with what comes before it
    both = F.aggregate(runs, F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out")), lambda s, r: F.struct(op(s["at"], F.element_at(r, -1)).alias("at"), F.concat(s["out"], F.array(F.transform(r, lambda x: op(s["at"], x)))).alias("out")))
    return F.when(n > 0, F.flatten(both["out"])).otherwise(none)


def candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """The documents with an array of (kind, start, end, match, before, after) of all kinds, that pass their base kind's checks.

    By kind and start.  Candidates of the further kinds that overlap a base span are left out.
    """
    own = free_prefix(docs)
    t = F.col(f"{own}_t")
    out = docs.withColumn(f"{own}_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(f"{own}_d", t.rlike("[0-9]"))
    empty = F.array().cast("array<string>")
    for k in KINDS:
        may = t.contains(_SIGN[k]) if k in _SIGN else F.lit(True) if k == "secret" else F.col(f"{own}_d")
        out = out.withColumn(f"{own}_m_{k}", F.when(may, F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty))
    for k in KINDS:
        out = out.withColumn(f"{own}_p_{k}", F.when(F.size(f"{own}_m_{k}") > 0, F.split(t, PATTERNS[k], -1)))
    for k in KINDS:
        both = F.zip_with(F.slice(f"{own}_p_{k}", F.lit(1), F.size(f"{own}_m_{k}")), f"{own}_m_{k}", lambda p, m: F.length(p) + F.length(m))
        out = out.withColumn(f"{own}_e_{k}", F.when(F.size(f"{own}_m_{k}") > 0, _running(both, lambda x, y: x + y, 0)))

    def spans(k: str) -> Column:
        m, pieces = F.col(f"{own}_m_{k}"), F.col(f"{own}_p_{k}")
        each = F.arrays_zip(m.alias("m"), F.col(f"{own}_e_{k}").alias("e"), F.slice(pieces, F.lit(1), F.size(m)).alias("p"), F.slice(pieces, F.lit(2), F.size(m)).alias("q"))
        made = F.transform(each, lambda z: F.struct(F.lit(k).alias("kind"), (z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("match"), F.lower(F.right(z["p"], F.lit(BEFORE))).alias("before"), F.left(z["q"], F.lit(AFTER)).alias("after")))
        return F.filter(made, valid) if k in BASE else made

    none = F.array().cast(_SPAN)
    out = out.withColumn(f"{own}_c", F.concat(*[F.when(F.size(f"{own}_m_{k}") > 0, spans(k)).otherwise(none) for k in KINDS]))
    # in order of starts: the furthest end of a base span so far, and the next start of one from here on
    mixed = F.exists(f"{own}_c", lambda c: c["kind"].isin(BASE)) & F.exists(f"{own}_c", lambda c: ~c["kind"].isin(BASE))
    key = F.transform(f"{own}_c", lambda c: F.struct(c["start"].alias("start"), (~c["kind"].isin(BASE)).alias("further"), c.alias("c")))
    out = out.withColumn(f"{own}_s", F.when(mixed, F.array_sort(key)))
    ends = F.transform(f"{own}_s", lambda x: F.when(x["further"], 0).otherwise(x["c"]["end"]))
    starts = F.transform(F.reverse(f"{own}_s"), lambda x: F.when(x["further"], _FAR).otherwise(x["start"]))
    out = out.withColumn(f"{own}_x", F.when(mixed, _running(ends, F.greatest, 0))).withColumn(f"{own}_y", F.when(mixed, F.reverse(_running(starts, F.least, _FAR))))
    zipped = F.arrays_zip(F.col(f"{own}_s").alias("s"), F.col(f"{own}_x").alias("x"), F.col(f"{own}_y").alias("y"))
    apart = F.transform(F.filter(zipped, lambda z: ~z["s"]["further"] | ((z["x"] <= z["s"]["start"]) & (z["y"] >= z["s"]["c"]["end"]))), lambda z: z["s"]["c"])
    out = out.withColumn(f"{own}_k", F.when(mixed, apart))
    by_kind = F.concat(*[F.filter(f"{own}_k", _of_kind(k)) for k in KINDS])
    kept = F.when(F.col(f"{own}_k").isNotNull(), by_kind).otherwise(F.col(f"{own}_c"))
    return out.withColumn(name, kept).select(*[c for c in docs.columns if c != name], name)


def valid(c: Column) -> Column:
    """Whether a candidate passes the checks of its base kind; true for the further kinds."""
    only = F.regexp_replace(c["match"], "[^0-9]", "")
    parts = F.split(c["match"], "\\.")
    return (
        F.when(c["kind"] == "ip", F.forall(parts, lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(c["kind"] == "card", F.length(only).between(13, 19) & F.call_function("luhn_check", only))
        .when(c["kind"] == "phone", F.length(only).between(9, 15))
        .otherwise(True)
    )


def _per_kind(c: Column, table: dict[str, str], column: str) -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(c["kind"] == k, c[column].rlike(table[k])).otherwise(out)
    return out


def votes(c: Column) -> Column:
    """1 for, -1 against, 0 no vote, by labeler; and the candidate's length class."""
    cue = _per_kind(c, {k: f"(?:^|[^a-z])(?:{w})[^a-z]{{0,6}}$" for k, w in CUES.items()}, "before")
    quoted = c["before"].rlike("[=:\"'(\\[<] ?[\"']?$")
    inside = c["before"].rlike("[A-Za-z0-9_@#/.-]$") | c["after"].rlike("^[A-Za-z0-9_@/]")
    return F.struct(
        F.when(_per_kind(c, STRICT, "match"), 1).otherwise(-1).alias("regex"),
        F.when(cue, 1).otherwise(0).alias("gazetteer"),
        F.when(quoted, 1).when(inside, -1).otherwise(0).alias("context"),
        F.least(F.lit(7), F.floor(F.length(c["match"]) / 8)).cast("int").alias("size"),
    )


LABELERS = ("regex", "gazetteer", "context")


def vote_table(found: DataFrame, name: str = "candidates") -> DataFrame:
    """Counts of (kind, votes, length class) over all candidates."""
    # an inner explode would have its filter, with all of the expression again, pushed down to the scan
    each = found.select(F.explode_outer(name).alias("c")).filter("c IS NOT NULL").select(F.col("c.kind").alias("kind"), votes(F.col("c")).alias("v"))
    return each.groupBy("kind", *[F.col(f"v.{x}").alias(x) for x in (*LABELERS, "size")]).agg(F.count("*").alias("n"))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(table: list[dict], rounds: int = 50) -> tuple[dict, list[float]]:
    """Expectation-maximisation over the vote table: P(vote | class) per labeler, and each row's posterior.

    Starts from the votes' sum; counts are smoothed, so empty tables and kinds give the start.
    """
    post = [_sigmoid(2.0 * sum(r[x] for x in LABELERS)) for r in table]
    given: dict = {}
    for _ in range(rounds):
        given = {}
        for x in LABELERS:
            for y in (0, 1):
                w = {v: 1.0 + (3.0 if v == (1 if y else -1) else 0.0) for v in (-1, 0, 1)}
                for r, p in zip(table, post, strict=True):
                    w[r[x]] += r["n"] * (p if y else 1 - p)
                given[x, y] = {v: c / sum(w.values()) for v, c in w.items()}
        prior = {}
        for k in KINDS:
            mine = [(r["n"], p) for r, p in zip(table, post, strict=True) if r["kind"] == k]
            prior[k] = (2 + sum(n * p for n, p in mine)) / (4 + sum(n for n, _ in mine))
        post = [_sigmoid(math.log(prior[r["kind"]] / (1 - prior[r["kind"]])) + sum(math.log(given[x, 1][r[x]] / given[x, 0][r[x]]) for x in LABELERS)) for r in table]
    return given, post


def train(table: list[dict], post: list[float], steps: int = 300) -> dict[str, float]:
    """Logistic span classifier on votes, kind and length class, fitted to the posteriors."""

    def features(r: dict) -> dict[str, float]:
        return {"bias": 1.0, f"kind {r['kind']}": 1.0, f"size {r['size']}": 1.0, **{f"{x} {r[x]}": 1.0 for x in LABELERS}}

    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    total = sum(r["n"] for r in table) or 1
    for _ in range(steps):
        slope: dict[str, float] = {}
        for r, y in zip(table, post, strict=True):
            f = features(r)
            e = (y - _sigmoid(sum(weights.get(k, 0.0) for k in f))) * r["n"] / total
            for k in f:
                slope[k] = slope.get(k, 0.0) + e
        for k, g in slope.items():
            g -= 1e-4 * weights.get(k, 0.0)
            squares[k] = squares.get(k, 1e-8) + g * g
            weights[k] = weights.get(k, 0.0) + 0.3 * g / math.sqrt(squares[k])
    return weights


def score(c: Column, v: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability as a column."""
    parts = [("kind", c["kind"]), *[(x, v[x].cast("string")) for x in (*LABELERS, "size")]]
    total = F.lit(weights.get("bias", 0.0))
    for name, value in parts:
        own = {k.partition(" ")[2]: w for k, w in weights.items() if k.partition(" ")[0] == name}
        e = F.lit(0.0)
        for key, w in own.items():
            e = F.when(value == key, F.lit(w)).otherwise(e)
        total = total + e
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.5, name: str = "spans") -> DataFrame:
    """The documents with an array of (kind, start, end, match, score), by kind and start, under `name`."""
    own = free_prefix(docs)
    found = candidates(docs, text, own)
    table = [r.asDict() for r in vote_table(found, own).collect()]  # kinds x votes x length classes
    table.sort(key=lambda r: tuple(str(r[x]) for x in ("kind", *LABELERS, "size")))
    weights = train(table, reliabilities(table)[1])
    scored = F.transform(own, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), score(c, votes(c), weights).alias("score")))
    kept = F.filter(scored, lambda s: s["kind"].isin(*BASE) | (s["score"] >= least))
    spans = F.when(F.size(own) > 0, kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,match:string,score:double>>"))
    return found.withColumn(name, spans).drop(own)


#: Code points in a piece of a text, in which a place is found by counting from the piece's start.
PIECE = 1024


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, if there is one, follows the text.

    Spans that begin within an earlier one make it longer.  A text is cut into pieces once, so that what stands between
    two spans is found without counting from the text's start.
    """
    own = free_prefix(docs)
    spans, order, ends, kept, pieces, new = (f"{own}_{x}" for x in ("spans", "order", "ends", "kept", "pieces", "text"))
    some = F.size(spans) > 0
    out = find_pii(docs, name=spans)
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    out = out.withColumn(order, F.when(some, by_start)).withColumn(pieces, F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    out = out.withColumn(ends, F.when(some, _running(F.transform(order, lambda s: -s["less"]), F.greatest, 0)))
    before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    out = out.withColumn(kept, F.when(some, F.filter(F.arrays_zip(F.col(order).alias("s"), before.alias("from")), lambda z: z["s"]["start"] >= z["from"])))

    def between(start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        one = F.substring(F.get(pieces, first), F.pmod(start, F.lit(PIECE)) + 1, end - start)
        more = F.concat(F.substring(F.get(pieces, first), F.pmod(start, F.lit(PIECE)) + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.coalesce(F.left(F.get(pieces, last), F.pmod(end, F.lit(PIECE))), F.lit("")))
        return F.coalesce(F.when(first == last, one).otherwise(more), F.lit(""))

    parts = F.transform(kept, lambda z: F.concat(between(z["from"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]")))
    tail = between(F.element_at(F.col(ends), -1), F.length("text"))
    out = out.withColumn(new, F.when(some, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*docs.columns)


def _of_kind(kind: str):
    return lambda c: c["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "spans")

    def text(kinds: list[str]) -> Column:
        return F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(text(BASE).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans"))
