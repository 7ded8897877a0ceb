"""Facts from source text: complexity of Python functions, response keys, middleware and string constants."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.routes import route_method, route_path

# What adds a path through a Python function.
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)


def _metrics(source: str) -> list[tuple[str, int, int, int, int]]:
    """Qualified name, first and last line (from 0), cyclomatic complexity and code lines of each function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = source.splitlines(), []

    def paths(node: ast.AST) -> int:
        n = 0
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                continue
            if isinstance(child, _BRANCH):
                n += 1 + (len(child.ifs) if isinstance(child, ast.comprehension) else 0)
            elif isinstance(child, ast.BoolOp):
                n += len(child.values) - 1
            elif isinstance(child, ast.match_case):
                n += 1
            n += paths(child)
        return n

    def walk(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = lines[child.lineno - 1 : child.end_lineno]
                sloc = sum(1 for x in own if x.strip() and not x.lstrip().startswith("#"))
                out.append((prefix + child.name, child.lineno - 1, child.end_lineno - 1, 1 + paths(child), sloc))
                walk(child, prefix + child.name + ".")
            else:
                walk(child, prefix + child.name + "." if isinstance(child, ast.ClassDef) else prefix)

    walk(tree, "")
    return out


def python_functions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, name, start_line, end_line, complexity, sloc`` of the functions in Python sources; broken sources have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *m) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for m in _metrics(t)]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["path", "name", "start_line", "end_line", "complexity", "sloc"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select(path, text).mapInArrow(run, "path string, name string, start_line long, end_line long, complexity long, sloc long")


_JSON = re.compile(r"(?:\.json|jsonify|JSONResponse|json_encode|NextResponse\.json)\s*\(\s*(?:\[|\{)")
_KEY = re.compile(r"""(?:['"]([\w-]+)['"]|([A-Za-z_$][\w$]*))\s*(?::|=>|,|\}|\]|$)""")
_STATUS = re.compile(r"status(?:Code|_code)?\s*[:=(]\s*(\d{3})")


def _top_keys(text: str, at: int) -> tuple[list[str], int]:
    """The keys of an object literal that opens before ``at``, not those of nested ones, and where it ends."""
    depth, start, parts, quote, i = 1, at, [], "", at
    while i < len(text) and depth:
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                parts.append(text[start:i])
        elif c == "," and depth == 1:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    keys = [m.group(1) or m.group(2) for p in parts if (m := _KEY.match(p.strip() + "\n".strip())) or (m := re.match(r"()([A-Za-z_$][\w$]*)$", p.strip()))]
    return keys, i


def response_shape(text: str) -> tuple[list[str], list[str]]:
    """Keys of the success and of the error responses that a handler builds; a status of 400 or more makes an error."""
    good, bad = [], []
    for m in _JSON.finditer(text):
        keys, end = _top_keys(text, m.end())
        near = _STATUS.findall(text[max(0, m.start() - 40) : m.start()]) + _STATUS.findall(text[end : end + 60].split("\n")[0])
        (bad if any(int(s) >= 400 for s in near) else good).extend(keys)
    unique = lambda ks: list(dict.fromkeys(ks))
    return unique(good), unique(bad)


def response_keys(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, response_keys, error_keys`` of the files that build a JSON response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *response_shape(t)) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            rows = [r for r in rows if r[1] or r[2]]
            if rows:
                keys = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), keys, keys])], names=["path", "response_keys", "error_keys"])

    return files.select(path, text).mapInArrow(run, "path string, response_keys array<string>, error_keys array<string>")


def middleware_chain(text: Column) -> Column:
    """The wrappers of a handler: those of ``chain([a, b])`` or ``compose([a, b])``, else of ``export default a(b(handler))``."""
    listed = F.regexp_extract(text, r"(?:chain|compose)\s*\(\s*\[([^\]]+)\]", 1)
    nested = F.regexp_extract(text, r"export\s+default\s+((?:\w+\s*\(\s*)+)", 1)
    split = lambda c, sep: F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin("function", "async"))
    return F.when(listed != "", split(listed, ",")).otherwise(split(nested, r"\("))


def constants(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, name, value`` of string constants, the first of a name in a file."""
    pattern = r"(?m)^\s*(?:export\s+)?(?:const\s+|final\s+|static\s+)*([A-Z_][A-Z0-9_]*)\s*(?::\s*\w+\s*)?=\s*['\"`]([^'\"`$]*)['\"`]"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    rows = files.select(F.col(path).alias("path"), F.posexplode(both).alias("k", "z"))
    return rows.groupBy("path", F.col("z.n").alias("name")).agg(F.min_by(F.col("z.v"), "k").alias("value"))


def fold_operands(expressions: DataFrame, known: DataFrame) -> DataFrame:
    """``expr_id, value``: sums of literals and constants as one string; none where an operand is unknown.

    ``expressions`` has ``expr_id, path, operands`` (quoted literals or names), ``known`` is ``constants``.
    """
    parts = expressions.select("expr_id", "path", F.size("operands").alias("n"), F.posexplode("operands").alias("k", "o"))
    literal = F.regexp_extract("o", r"^['\"`](.*)['\"`]$", 1)
    quoted = F.col("o").rlike(r"^['\"`].*['\"`]$")
    named = parts.join(known.select("path", F.col("name").alias("o"), "value"), ["path", "o"], "left")
    valued = named.select("expr_id", "n", "k", F.when(quoted, literal).otherwise(F.col("value")).alias("v")).filter("v is not null")
    done = valued.groupBy("expr_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).filter(F.size("p") == F.col("n"))
    return done.select("expr_id", F.array_join(F.transform("p", lambda x: x["v"]), "").alias("value"))


# How frameworks declare routes: language ending, pattern, place of the method and of the path.
ROUTE_PATTERNS = [
    ("fastapi", "py", r"@\w+\.(get|post|put|patch|delete|head|options)\(\s*['\"]([^'\"]*)['\"]", 1, 2),
    ("django", "py", r"\b(?:re_)?path\(\s*r?['\"]([^'\"]*)['\"]", 0, 1),
    ("spring", "(?:java|kt)", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"", 1, 2),
    ("gin", "go", r"\b\w+\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\(\s*\"([^\"]*)\"", 1, 2),
    ("express", "(?:js|ts|mjs)", r"\b(?:app|router)\.(get|post|put|patch|delete|head|options)\(\s*['\"`]([^'\"`]*)['\"`]", 1, 2),
]
# How a file gives all its routes a prefix.
PREFIXES = {"fastapi": r"APIRouter\([^)]*prefix\s*=\s*['\"]([^'\"]*)['\"]", "spring": r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"", "gin": r"\.Group\(\s*\"([^\"]*)\""}


def framework_routes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, framework, method, url`` of routes that code declares, with the prefix of their file."""
    out = None
    for framework, ending, pattern, method, place in ROUTE_PATTERNS:
        rows = files.filter(F.col(path).rlike(rf"\.{ending}$"))
        found = F.arrays_zip(
            (F.regexp_extract_all(text, F.lit(pattern), F.lit(method)) if method else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(place)), lambda x: F.lit("*"))).alias("m"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(place)).alias("u"),
        )
        prefix = F.regexp_extract(text, PREFIXES[framework], 1) if framework in PREFIXES else F.lit("")
        rows = rows.select(F.col(path).alias("path"), F.lit(framework).alias("framework"), prefix.alias("prefix"), F.explode(found).alias("z"))
        rows = rows.select("path", "framework", route_method(F.col("z.m")).alias("method"), route_path(F.col("z.u"), F.col("prefix")).alias("url"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
