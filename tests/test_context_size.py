"""Contexts of questions: the rows, and how small they are shuffled and written."""

import hashlib
from pathlib import Path

from ripplemark.operators import context

HINTS = 60


def lines(h):
    return "".join(hashlib.sha256(f"{h}/{k}".encode()).hexdigest() for k in range(400))


def test_texts_are_put_together_once(spark, tmp_path):
    """Questions that name the same share a text, in whatever parts they stand; others have their own symbol's, or none."""
    asked = [(n, f"of file{n % HINTS}.py: word{n % HINTS} beta{n % 3} unheard{n}", "seed" if n % 50 == 7 else "lost" if n % 50 == 9 else None) for n in range(3000)]
    asked += [(5000, "", None), (5001, None, None), (5002, "in other.py", None), (5003, "beta1 beta1 word2", None), (5004, "word2 beta1 beta1", None)]
    files = {f"file{k}.py": lines(k) for k in range(HINTS)}
    words = {f"word{k}": f"W{k}" for k in range(HINTS)} | {"beta0": "B0", "beta1": "B1"}
    want = {}
    for n, q, seed in asked:
        named = [files[w.rstrip(":")] for w in (q or "").split() if w.rstrip(":") in files] + [words[w] for w in (q or "").replace(".", " ").split() if w in words]
        want[n] = "S" if seed == "seed" else "\n".join(named) if named else "No data found in graph for: other.py" if n == 5002 else "No symbol context provided."
    table = lambda x: spark.createDataFrame(list(x.items()), "hint string, lines string")
    questions = spark.createDataFrame(asked, "question_id long, question string, symbol_hint string").repartition(8, "question_id")
    df = context.answer_context(questions, table(files), table(words), spark.createDataFrame([("seed", "S")], "symbol_hint string, lines string"))
    df.write.parquet(f"{tmp_path}/out")
    assert {r.question_id: r.context for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and df.count() == len(want)
    whole, once = sum(map(len, want.values())), len("".join(files.values()))
    assert whole > 40 * once and sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet")) < 4 * once
    plain = context.answer_context(questions, table(files), table(words))
    assert plain.filter("question_id = 7").first()["context"].startswith(files["file7.py"]) and plain.count() == len(want)
    empty = context.answer_context(questions.limit(0), table(files), table(words))
    assert empty.count() == 0
