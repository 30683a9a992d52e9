"""Source text to symbols, imports and calls.

`parse_sources` takes parsers by language, so other grammars can be plugged in; Python comes with
one on the standard library's syntax trees.  A parser is `parse(content: bytes, path: str) ->
(symbols, imports, calls)`, lists of tuples in the order of the schemas below (a call's owner and
parent aside, which are found here).

Files are dealt into partitions of about equal bytes first, and calls are put to their symbols
while a file is at hand, so that neither a window nor a join by call follows.
"""

from __future__ import annotations

import ast
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import detect_language
from ..operators.upsert import cut

SYMBOL = "struct<pos:int,name:string,kind:string,line:int,end_line:int,parent:string>"
IMPORT = "struct<pos:int,module:string,name:string,alias:string>"
CALL = "struct<pos:int,caller:string,callee:string,line:int,owner:int,parent:string>"
PARSED = f"repo_id string, path string, language string, hash string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>, error string"

#: Bytes of source parsed in one task, and what a file counts beyond its bytes.
PART_BYTES, FILE_BYTES = 16_000_000, 500
#: Bytes of source whose parsed rows a task holds before it hands them on.
HELD_BYTES = 1_000_000
#: Hashed cells whose bytes are summed; their sums are broadcast.
CELLS = 65_536

Parser = Callable[[bytes, str], tuple[list, list, list]]


class _Visitor(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.scopes = text.encode().splitlines(keepends=True), []
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.calls: list[tuple] = []

    def _text(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]).decode()

    def _define(self, node: ast.AST, kind: str, parent: str | None) -> None:
        self.symbols.append((len(self.symbols), node.name, kind, node.lineno, node.end_lineno, parent))

    def _function(self, node) -> None:
        owner = next((n for n, c in reversed(self.scopes) if c), None)
        self._define(node, "constructor" if node.name == "__init__" else "method" if owner else "function", owner)
        for x in node.decorator_list:
            self.visit(x)
        self.scopes.append((node.name, False))
        for x in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(x)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class", self.scopes[-1][0] if self.scopes else None)
        for x in node.decorator_list:
            self.visit(x)
        self.scopes.append((node.name, True))
        for x in [*node.bases, *node.keywords, *node.body]:
            self.visit(x)
        self.scopes.pop()

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [(len(self.imports) + k, a.name, None, a.asname) for k, a in enumerate(node.names)]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module == "__future__":
            return
        module = "." * node.level + (node.module or "")
        self.imports += [(len(self.imports) + k, module, a.name, a.asname) for k, a in enumerate(node.names)]

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            callee = f.id
        elif isinstance(f, ast.Attribute):
            callee = f.attr if isinstance(f.value, ast.Name) and f.value.id == "self" else f"{self._text(f.value)}.{f.attr}"
        else:
            callee = self._text(f)
        if callee:
            self.calls.append((len(self.calls), self.scopes[-1][0] if self.scopes else "<module>", callee, node.lineno))
        self.generic_visit(node)


def parse_python(content: bytes, path: str) -> tuple[list, list, list]:
    """Symbols, imports and calls of a Python file; module variables come last."""
    text = content.decode("utf-8", "replace")
    tree = ast.parse(text)
    v = _Visitor(text)
    v.visit(tree)
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            names = [t] if isinstance(t, ast.Name) else t.elts if isinstance(t, ast.Tuple) else []
            for n in names:
                if isinstance(n, ast.Name) and not n.id.startswith("_"):
                    v.symbols.append((len(v.symbols), n.id, "variable", node.lineno, node.end_lineno, None))
    return v.symbols, v.imports, v.calls


PARSERS: dict[str, Parser] = {"python": parse_python}


def call_owners(symbols: list[tuple], calls: list[tuple]) -> list[int | None]:
    """For each call the place of the narrowest symbol that has the caller's name and holds its line, of equal ones the first.

    One sweep by line: symbols are opened as they begin, a heap for each name, the narrowest on top; those that have
    ended are taken off when they come to the top, as no later call lies in them.
    """
    begun = sorted(range(len(symbols)), key=lambda k: symbols[k][3])
    opened: dict[str, list[tuple[int, int, int]]] = {}
    out: list[int | None] = [None] * len(calls)
    at = 0
    for c in sorted(range(len(calls)), key=lambda k: calls[k][3]):
        _, caller, _, line = calls[c]
        while at < len(begun) and symbols[begun[at]][3] <= line:
            _, name, _, start, end, _ = symbols[begun[at]]
            heapq.heappush(opened.setdefault(name, []), (end - start, begun[at], end))
            at += 1
        heap = opened.get(caller, [])
        while heap and heap[0][2] < line:
            heapq.heappop(heap)
        out[c] = heap[0][1] if heap else None
    return out


def packed(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The files (repo_id, path, content, and size if it is known) in partitions of about equal bytes.

    A file's place is the running sum of bytes over hashed cells up to its own, and within a cell, which holds many
    files where there are more files than cells, a share of the cell's bytes by another hash.  So no file is moved twice,
    no window has more rows than there are cells, and a task that is run again gets the same files.  One exchange.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    key = F.xxhash64("repo_id", "path")
    placed = files.withColumns({"_cell": F.pmod(key, F.lit(CELLS)).cast("int"), "_share": F.pmod(F.shiftrightunsigned(key, 17), F.lit(1 << 30)) / (1 << 30)})
    sums = cut(placed.groupBy("_cell").agg(F.sum(F.coalesce(size.cast("long"), F.lit(0)) + FILE_BYTES).alias("_bytes")))
    total = sums.agg(F.sum("_bytes")).first()[0]
    if not total:
        return files
    parts = max(-(-total // part_bytes), min(files.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES)))
    before = sums.withColumn("_before", F.sum("_bytes").over(Window.orderBy("_cell")) - F.col("_bytes"))
    own = F.floor((F.col("_before") + F.col("_share") * F.col("_bytes")) * parts / total).cast("int")
    dealt = placed.join(F.broadcast(before), "_cell")  # at most CELLS rows of three numbers
    return dealt.withColumn("_part", F.least(own, F.lit(parts - 1).cast("int"))).repartitionById(parts, "_part").select(*files.columns)


def parsed_frames(frames: Iterator[pd.DataFrame], parsers: dict[str, Parser]) -> Iterator[pd.DataFrame]:
    """PARSED rows of files (repo_id, path, language, hash, content), handed on as soon as HELD_BYTES of source are parsed."""

    def made(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["repo_id", "path", "language", "hash", "symbols", "imports", "calls", "error"])

    for df in frames:
        rows, held = [], 0
        for r in df.itertuples(index=False):
            try:
                symbols, imports, calls = parsers[r.language](bytes(r.content), r.path)
                owned = [(*c, k, None if k is None else symbols[k][5]) for c, k in zip(calls, call_owners(symbols, calls), strict=True)]
                lists = (symbols, imports, owned)
                keys = (("pos", "name", "kind", "line", "end_line", "parent"), ("pos", "module", "name", "alias"), ("pos", "caller", "callee", "line", "owner", "parent"))
                got = [[dict(zip(k, x, strict=True)) for x in part] for k, part in zip(keys, lists, strict=True)]
                rows.append((r.repo_id, r.path, r.language, r.hash, *got, None))
            except Exception as e:  # a parser may fail in any way on foreign text; the row says how
                rows.append((r.repo_id, r.path, r.language, r.hash, None, None, None, f"{type(e).__name__}: {e}"))
            held += len(r.content or b"") + FILE_BYTES
            if held >= HELD_BYTES:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


def parse_sources(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """One row for each file (repo_id, path, content) of a language with a parser: PARSED.

    Files that fail have an error and no lists; they get no snapshot, so they are tried again.  A call's owner is the
    place in the file of the symbol that makes it, with that symbol's parent; null where none does.
    """
    parsers = parsers or PARSERS
    use = files.withColumn("language", detect_language(F.col("path"))).filter(F.col("language").isin(list(parsers)))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return parsed_frames(frames, parsers)

    return packed(use).select("repo_id", "path", "language", F.sha2("content", 256).alias("hash"), "content").mapInPandas(each, PARSED)


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Flat symbols, imports and calls of the files that parsed."""
    good = parsed.filter("error IS NULL")
    return {n: good.select("repo_id", "path", F.explode(n).alias("x")).select("repo_id", "path", "x.*") for n in ("symbols", "imports", "calls")}


def parse_failures(parsed: DataFrame) -> DataFrame:
    """Files that failed, and how."""
    return parsed.filter("error IS NOT NULL").select("repo_id", "path", "error")


def parse_include_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, pos, module, name) of Java imports and C/C++ includes, from (repo_id, path, text)."""
    lines = files.withColumn("language", detect_language(F.col("path"))).select("repo_id", "path", "language", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    java = F.regexp_extract("line", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", 1)
    cpp = F.regexp_extract("line", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    target = F.when(F.col("language") == "java", java).when(F.col("language") == "cpp", cpp).otherwise("")
    dotted = (F.col("language") == "java") & F.col("t").contains(".")
    out = lines.withColumn("t", target).filter("t <> ''")
    return out.select("repo_id", "path", "pos", F.when(dotted, F.regexp_extract("t", r"^(.*)\.[^.]*$", 1)).otherwise(F.col("t")).alias("module"), F.when(dotted, F.substring_index("t", ".", -1)).alias("name"))
