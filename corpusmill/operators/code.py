"""Source-code filters; what needs a parser is an Arrow UDF."""

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import by_pieces
from corpusmill.functions.expr import col, contains_any, strip
from corpusmill.functions.phrases import phrases
from corpusmill.functions.text import correct_by_dict


def _imports(code: str | None) -> list[str] | None:
    """Module names of all imports; null if the code does not parse."""
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except Exception:  # the parser raises several kinds on odd input
        return None
    return [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]


imports = by_pieces(lambda: lambda codes: [_imports(c) for c in codes], T.ArrayType(T.StringType()))


def _docstrings(code: str | None) -> list[str]:
    """Docstrings of modules, classes and functions; none if the code does not parse."""
    try:
        nodes = ast.walk(ast.parse(code or ""))
        found = (ast.get_docstring(n) for n in nodes if isinstance(n, (ast.FunctionDef, ast.ClassDef, ast.Module)))
        return [d for d in found if d]
    except Exception:
        return []


docstrings = by_pieces(lambda: lambda codes: [_docstrings(c) for c in codes], T.ArrayType(T.StringType()))


def imports_allowed(modules, denied=None) -> Column:
    top = F.transform(col(modules), lambda m: F.substring_index(m, ".", 1))
    return F.coalesce(~F.arrays_overlap(top, F.array(*[F.lit(x) for x in denied or phrases("code_deny")])), F.lit(False))


def clean_code(code, modules=None) -> Column:
    """Parses, imports nothing of the deny list, and names no low-level call."""
    return imports_allowed(imports(col(code)) if modules is None else modules) & ~contains_any(code, phrases("code_words"))


def good_libraries(code, modules=None) -> Column:
    """Some imported module starts with a name of the allow list."""
    m = imports(col(code)) if modules is None else col(modules)
    names = phrases("code_allow")
    return F.coalesce(F.exists(m, lambda x: F.greatest(*[x.startswith(n) for n in names])), F.lit(False))


def code_file(name, code, least: int = 10, most: int = 300) -> Column:
    n = F.size(F.split(strip(code), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"))
    return ~contains_any(F.lower(col(name)), phrases("code_names")) & n.between(least, most)


def ml_code(code) -> Column:
    return contains_any(code, phrases("ml"))


def python_files(files: DataFrame, name: str = "path", code: str = "content") -> DataFrame:
    """Files that pass the name and size gate, use a known library and nothing low-level. Cheap tests come first."""
    x = files.where(code_file(name, code)).withColumn("_m", imports(F.col(code)))
    return x.where(good_libraries(code, "_m") & clean_code(code, F.col("_m"))).drop("_m")


def comment_text(code) -> Column:
    """Docstrings, then what follows the first # of every line."""
    tails = F.transform(F.filter(F.split(col(code), "\n"), lambda x: F.contains(x, F.lit("#"))), lambda x: F.substring(x, F.instr(x, "#") + 1, F.length(x)))
    return F.concat(docstrings(col(code)), tails)


def code_shard(files: DataFrame, date: str = "max_forks_repo_forks_event_min_datetime", allowed: str | None = None) -> DataFrame:
    """Recent, mid-sized Python files with a share of plain comments and a listed import near the top, normalised."""
    x = files.where(F.col(date).isNotNull() & (F.substring(date, 1, 4).cast("int") >= 2018) & F.col("size").between(100, 25_000))
    x = x.where(contains_any(F.substring("content", 1, 600), phrases("shard_imports")))
    x = x.withColumn("_c", F.array_join(comment_text("content"), ""))
    ratio = F.length("_c") / F.col("size")
    plain = ~F.col("_c").rlike(r"[^\x09-\x0D\x20-\x7E]") if allowed is None else F.length(F.translate("_c", allowed, "")) == 0
    return x.where(ratio.between(0.1, 0.7) & plain).drop("_c").withColumn("content", correct_by_dict(F.col("content")))
