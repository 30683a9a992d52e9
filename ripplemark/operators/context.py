"""Context for questions about the code, from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impact import first_n
from .numbers import identified
from .upsert import cut

# Words of a question that name no symbol.
STOP_WORDS = """what does this that how many the are for has have here there where which with from into line
method methods function functions class classes file code project about explain describe show change will get
impacted calls called call who why can could should would all any some every if is it its my me no not of on or
our out so to up use was we you your""".split()
FILE_PATTERN = r"(?U)[\w\-/]+\.(?:py|ts|js|java|cpp|c|h|tsx|jsx)"
WORD_PATTERN = r"(?U)\b[a-zA-Z_]\w*\b"


def extract_hints(questions: DataFrame) -> DataFrame:
    """Questions with `files` and `words` that they name, in order."""
    words = F.regexp_extract_all("question", F.lit(WORD_PATTERN), F.lit(0))
    return questions.withColumn("files", F.regexp_extract_all("question", F.lit(FILE_PATTERN), F.lit(0))).withColumn("words", F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS)))


def hint_table(hints: DataFrame, column: str) -> DataFrame:
    """Distinct hints of a column."""
    return hints.select(F.explode(column).alias("hint")).distinct()


def _containing(hints: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """Rows whose text contains a hint, as an equi-join by the hint's three letters that fewest texts hold.

    Hints shorter than three letters can't occur: words have three, files four at least.  The hints with their letters
    are written first: where their table is small, rows meet it where they stand, and only rows that hold a hint's
    letters are kept, in place of a shuffle of each row by each of its letters.
    """

    def of(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) - 2)), lambda i: F.substring(F.col(column), i, F.lit(3))))))

    rows = of(table.select(text), text).groupBy("gram").agg(F.count("*").alias("rows"))
    keyed = cut(of(hints, "hint").join(rows, "gram", "left").groupBy("hint").agg(F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)), "gram")).alias("gram")))
    return of(table, text).join(keyed, "gram").filter(F.col(text).contains(F.col("hint"))).drop("gram")


def symbol_context(hints: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(hint, lines): each hint's symbols with what they call, and who calls them."""
    symbols, edges = cut(symbols.repartition("qualified_name")), cut(edges)  # both are read several times; equal parts, as letters take long
    some = cut(_containing(hints, symbols, "qualified_name").select("hint", "repo_id", "qualified_name", "name", "type", "start_line", "file_path"))
    picked = cut(first_n(some, ["hint"], ["qualified_name"], limit))
    names = symbols.select("repo_id", F.col("qualified_name").alias("dst"), F.col("name").alias("callee"))
    mine = picked.select("repo_id", F.col("qualified_name").alias("src")).distinct()  # callees are gathered for these alone
    calls = edges.join(mine, ["repo_id", "src"], "left_semi").join(names, ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("qualified_name")).agg(F.array_join(F.sort_array(F.collect_set("callee")), ", ").alias("calls"))
    own = picked.join(calls, ["repo_id", "qualified_name"], "left")
    line = F.concat(F.lit("Symbol: "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(") in "), F.col("file_path"), F.lit(" at line "), F.col("start_line").cast("string"), F.coalesce(F.concat(F.lit("\n  Calls: "), F.col("calls")), F.lit("")))
    out = own.groupBy("hint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qualified_name", line.alias("t")))), lambda x: x["t"]), "\n").alias("own"))
    who = symbols.select("repo_id", F.col("qualified_name").alias("src"), F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(") in "), F.col("file_path")).alias("who"))
    callers = first_n(some.select("hint", "repo_id", F.col("qualified_name").alias("dst")).join(edges, ["repo_id", "dst"]).join(who, ["repo_id", "src"]), ["hint"], ["src", "dst"], limit)
    called = callers.groupBy("hint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "who"))), lambda x: x["who"]), ", ").alias("called"))
    return out.join(called, "hint", "left").select("hint", F.concat("own", F.coalesce(F.concat(F.lit("\nCalled by: "), F.col("called")), F.lit(""))).alias("lines"))


def file_context(hints: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, limit: int = 5) -> DataFrame:
    """(hint, lines): each hint's files with their imports (through their symbols) and symbols."""
    some = first_n(_containing(hints, files.select("repo_id", "path"), "path"), ["hint"], ["path", "repo_id"], limit)
    s = symbols.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.array_sort(F.collect_set(F.struct("start_line", "name", "type"))).alias("symbols"))
    i = imports.groupBy("repo_id", "path").agg(F.array_join(F.sort_array(F.collect_set("module")), ", ").alias("imports"))
    each = some.join(s, ["repo_id", "path"], "left").join(i, ["repo_id", "path"], "left")
    body = F.transform("symbols", lambda x: F.concat(F.lit("  - "), x["name"], F.lit(" ("), x["type"], F.lit(") at line "), x["start_line"].cast("string")))
    text = F.concat_ws("\n", F.concat(F.lit("File: "), F.col("path")), F.when(F.col("imports") != "", F.concat(F.lit("Imports: "), F.col("imports"))), F.when(F.size("symbols") > 0, F.concat(F.lit("Symbols ("), F.size("symbols").cast("string"), F.lit("):\n"), F.array_join(body, "\n"))).otherwise("(No function/class definitions found in graph)"))
    return each.groupBy("hint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "repo_id", text.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))


def seed_context(radius: DataFrame, coverage: DataFrame, hints: DataFrame) -> DataFrame:
    """(symbol_hint, lines): test files and blast radius of a question's own symbol, over all repositories."""
    quote = F.when(F.contains("test_file", F.lit("'")) & ~F.contains("test_file", F.lit('"')), '"').otherwise("'")
    rows = F.array_sort(F.collect_list(F.struct("test_file", "test_name", F.concat(quote, "test_file", quote).alias("t"))))
    tests = coverage.groupBy(F.col("seed").alias("symbol_hint")).agg(F.array_join(F.transform(rows, lambda x: x["t"]), ", ").alias("tests"))
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(") in "), F.col("file"), F.lit(" [depth "), F.col("depth").cast("string"), F.lit("]"))
    down = radius.groupBy(F.col("seed").alias("symbol_hint")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name", "file", "kind", line.alias("t")))), lambda x: x["t"]), "\n").alias("down"))
    out = hints.select("symbol_hint").distinct().join(tests, "symbol_hint", "left").join(down, "symbol_hint", "left")
    has = F.concat(F.lit("["), F.coalesce("tests", F.lit("")), F.lit("]"))
    return out.select("symbol_hint", F.concat(F.lit("Symbol: "), F.col("symbol_hint"), F.lit("\nHas test coverage: "), has, F.lit("\n"), F.coalesce(F.concat(F.lit("Downstream symbols:\n"), F.col("down")), F.lit("No downstream symbols found in the graph."))).alias("lines"))


#: Bytes of different contexts that one task writes, if it can: they fit Parquet's dictionary, so that equal ones are written once.
CONTEXT_BYTES = 400_000


def _texts(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(question_id, list) of the questions that name something known, (list, text) dealt out by list, and in how many parts.

    asked: (question_id, i, k, hint); known: (k, hint, lines).  Questions that name the same in the same order have one
    list of hints, whose text is put together once; so a text is shuffled once for each list, not for each question.
    """
    known = cut(known.withColumn("id", F.monotonically_increasing_id()))
    ids = asked.join(known.select("k", "hint", "id"), ["k", "hint"]).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("i", "id")))["id"].alias("ids"))
    ids = cut(ids)
    lists = identified(ids.select("ids"), "list")
    each = lists.select("list", F.posexplode("ids").alias("i", "id"))
    sizes = each.join(known.select("id", F.octet_length("lines").alias("n")), "id").agg(F.sum("n"), F.count_distinct("list")).first()
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sizes[1], (sizes[0] or 0) // CONTEXT_BYTES))
    pieces = each.join(known.select("id", "lines"), "id").repartition(parts, "list")
    texts = pieces.groupBy("list").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "lines"))), lambda x: x["lines"]), "\n").alias("text"))
    return ids.join(lists, "ids").select("question_id", "list"), texts, parts


def answer_context(questions: DataFrame, of_file: DataFrame, of_symbol: DataFrame, of_seed: DataFrame | None = None) -> DataFrame:
    """(question_id, context): the text for each question; its own symbol's if it has one, else its hints' in order."""
    hints, own = extract_hints(questions), None
    if of_seed is not None:
        of_seed = cut(of_seed)
        own = hints.join(of_seed, "symbol_hint").select("question_id", F.col("lines").alias("context"))
        hints = hints.join(of_seed, "symbol_hint", "left_anti")
    asked = hints.select("question_id", F.posexplode(F.concat(F.transform("files", lambda x: F.struct(F.lit(0).alias("k"), x.alias("hint"))), F.transform("words", lambda x: F.struct(F.lit(1).alias("k"), x.alias("hint"))))).alias("i", "h")).select("question_id", "i", "h.k", "h.hint")
    of_question, texts, parts = _texts(asked, of_file.withColumn("k", F.lit(0)).unionByName(of_symbol.withColumn("k", F.lit(1))))
    none = F.when(F.size("files") > 0, F.concat(F.lit("No data found in graph for: "), F.array_join("files", ", "))).otherwise("No symbol context provided.")
    # questions go to the texts, which stay where they were put together
    named = hints.select("question_id", none.alias("none")).join(of_question, "question_id", "left")
    some = named.filter("list IS NOT NULL").repartition(parts, "list").join(texts, "list").select("question_id", F.col("text").alias("context"))
    out = some.unionByName(named.filter("list IS NULL").select("question_id", F.col("none").alias("context")))
    return out if own is None else out.unionByName(own)
