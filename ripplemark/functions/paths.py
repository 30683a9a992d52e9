"""Columns on paths, names, import statements and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix, folders that are always left out, and standard packages.
LANGUAGES = {
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "cpp": [".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".hxx"],
}
SKIP_DIRS = [".git", "__pycache__", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".venv", "venv", ".eggs", ".idea", ".vscode"]
BUILTIN_PACKAGES = ["abc", "argparse", "collections", "datetime", "functools", "io", "itertools", "json", "logging", "math", "os", "pathlib", "re", "sqlite3", "subprocess", "sys", "typing", "unittest", "urllib", "uuid"]


def suffix(path: Column) -> Column:
    """The last suffix in lower case; empty for none and for bare dot-files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language of a path by its suffix, else null."""
    s = suffix(path)
    return F.coalesce(*[F.when(s.isin(v), F.lit(k)) for k, v in LANGUAGES.items()])


def in_skipped_dir(path: Column) -> Column:
    """Whether a component of the path (relative to its repository) is a skipped folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def is_test_file(path: Column) -> Column:
    """Whether "test" is anywhere in the path."""
    return F.lower(path).contains("test")


def is_test_symbol(name: Column, path: Column) -> Column:
    """A symbol of a test file, or one whose name starts with test_."""
    return name.startswith("test_") | is_test_file(path)


def module_name(path: Column) -> Column:
    """Dotted module of a path; a package's __init__ is the package."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"\.__init__$", "")


def qualified_name(repo_id: Column, module: Column, parent: Column, name: Column) -> Column:
    """The parts that aren't empty, joined by dots."""
    return F.concat_ws(".", *[F.when(c != "", c) for c in (repo_id, module, parent, name)])


def module_root(path: Column) -> Column:
    """First component of a path; a file in the root is its own."""
    return F.get(F.split(path, "/"), 0)


def repo_id(remote: Column, path: Column) -> Column:
    """First ten hex digits of the SHA-1 of the remote, or of the path without one."""
    return F.substring(F.sha1(F.coalesce(F.when(remote != "", remote), path).cast("binary")), 1, 10)


def repo_name(remote: Column, path: Column) -> Column:
    """Last part of the remote without .git, or of the path without a remote."""
    tail = F.replace(F.element_at(F.split(F.rtrim(remote, F.lit("/")), "/"), -1), F.lit(".git"), F.lit(""))
    return F.coalesce(F.when(remote != "", tail), F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1))


def content_hash(content: Column) -> Column:
    """SHA-256 hex of the bytes."""
    return F.sha2(content.cast("binary"), 256)


def import_statement(module: Column, name: Column, alias: Column) -> Column:
    """Text of an import."""
    plain = F.when(name.isNull() | (name == ""), F.concat(F.lit("import "), module)).otherwise(F.concat(F.lit("from "), module, F.lit(" import "), name))
    return F.concat(plain, F.coalesce(F.when(alias != "", F.concat(F.lit(" as "), alias)), F.lit("")))


def parse_import_statement(text: Column) -> Column:
    """Module of an import's text; null if it is no import."""
    t = F.trim(text)
    plain = F.trim(F.substring_index(F.substring(t, 8, 1 << 30), " as ", 1))
    whole = F.trim(F.substring_index(F.substring(t, 6, 1 << 30), " import ", 1))
    return F.when(t.startswith("import "), plain).when(t.startswith("from ") & t.contains(" import "), whole)


def is_external(package: Column) -> Column:
    """Not a relative import."""
    return ~package.startswith(".")


def is_builtin(package: Column) -> Column:
    """The root module is one of the fixed standard packages."""
    return F.get(F.split(package, r"\."), 0).isin(BUILTIN_PACKAGES)


def normalize_call(text: Column) -> Column:
    """(text, method): a call's text without its last (), cut at the first ()., and its last part."""
    bare = F.substring_index(F.regexp_replace(F.trim(text), r"\(\)$", ""), "().", 1)
    return F.struct(bare.alias("text"), F.when(bare.contains("."), F.substring_index(bare, ".", -1)).alias("method"))


def all_of(conditions: list[Column]) -> Column:
    """Conjunction."""
    return reduce(lambda a, b: a & b, conditions)
