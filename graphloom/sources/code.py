"""Source code to symbols, edges and unresolved calls: the syntax tree for Python, line patterns for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = {".py": "python", ".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js", ".go": "go", ".rs": "rust"}
PATTERNS = {
    "go": (r"^func\s+(?:\(\s*\w*\s*\*?(?P<receiver>\w+)[^)]*\)\s*)?(?P<name>\w+)", r"^type\s+(\w+)", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"$'),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*use\s+([\w:]+)"),
    "ts": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+(\w+)", r"""^\s*(?:import|export)\b.*?from\s+['"]([^'"]+)['"]"""),
}
PATTERNS["js"] = PATTERNS["ts"]
SUFFIXES = r"\.(" + "|".join(x[1:] for x in LANGUAGES) + ")$"
#: The types that a Go signature or field names, through pointers, slices, maps, channels and functions; predeclared ones are in small letters.
GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)(.*)$")
GO_PACKAGE = re.compile(r"^package\s+(\w+)", re.M)
GO_STRUCT = re.compile(r"^type\s+(\w+)\s+(?:struct|interface)\s*\{")
GO_TYPE = re.compile(r"(?<![\w.\"])([A-Z]\w*)(?!\s*\()")
CALL = re.compile(r"(?<![\w.])(new\s+)?(?:(\w+)\.)?(\w+)\s*\(")
WORDS = {"if", "for", "while", "switch", "return", "func", "function", "fn", "match", "catch", "def", "class", "with", "and", "or", "not", "in", "print"}
Symbol = tuple[str, str, int]  #: kind, name, line
Call = tuple[str, str, str, int, bool]  #: caller ('' for the file), callee, receiver, line, whether it makes an object


def python_symbols(text: str) -> tuple[list[Symbol], list[Call], list[str]]:
    symbols: list[Symbol] = []
    calls: list[Call] = []
    imports: list[str] = []

    def walk(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "type" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                inner = f"{scope}.{child.name}" if scope else child.name
                symbols.append((kind, inner, child.lineno))
            elif isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append("." * child.level + (child.module or ""))
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    calls.append((scope, f.id, "", child.lineno, f.id[:1].isupper()))
                elif isinstance(f, ast.Attribute):
                    calls.append((scope, f.attr, f.value.id if isinstance(f.value, ast.Name) else "", child.lineno, False))
            walk(child, inner)

    walk(ast.parse(text), "")
    return symbols, calls, imports


def pattern_symbols(text: str, language: str) -> tuple[list[Symbol], list[Call], list[str]]:
    function, type_, import_ = (re.compile(p) for p in PATTERNS[language])
    symbols, calls, imports, scope = [], [], [], ""
    for n, line in enumerate(text.split("\n"), 1):
        name = lambda m: next(g for g in m.groups() if g)
        if m := import_.match(line):
            imports.append(name(m))
            continue
        if m := function.match(line):
            receiver = m.groupdict().get("receiver")
            scope = f"{receiver}.{m['name']}" if receiver else m["name"] if language == "go" else name(m)
            symbols.append(("method" if receiver else "function", scope, n))
            line = line[m.end() :]
        elif m := type_.match(line):
            symbols.append(("type", name(m), n))
            continue
        calls += [(scope, m[3], m[2] or "", n, bool(m[1])) for m in CALL.finditer(line) if m[3] not in WORDS]
    return symbols, calls, imports


def python_types(text: str) -> list[tuple[str, str]]:
    """(symbol, type) of annotations of parameters, results and fields, through subscripts and unions."""
    found: list[tuple[str, str]] = []

    def named(node: ast.AST | None) -> list[str]:
        if node is None:
            return []
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval")
            except SyntaxError:
                return []
        return [x.id for x in ast.walk(node) if isinstance(x, ast.Name)]

    def walk(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner = f"{scope}.{child.name}" if scope else child.name
                a = child.args
                for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg]:
                    found.extend((inner, t) for t in named(x.annotation if x else None))
                found.extend((inner, t) for t in named(child.returns))
            elif isinstance(child, ast.ClassDef):
                inner = f"{scope}.{child.name}" if scope else child.name
            elif isinstance(child, ast.AnnAssign) and scope:
                found.extend((scope, t) for t in named(child.annotation))
            walk(child, inner)

    walk(ast.parse(text), "")
    return list(dict.fromkeys(found))


def go_types(text: str) -> list[tuple[str, str]]:
    """(symbol, type) of the signatures and fields of Go source."""
    found, struct = [], ""
    for line in text.split("\n"):
        if struct and line.startswith("}"):
            struct = ""
        elif struct:
            found += [(struct, t) for t in GO_TYPE.findall(line.split("//")[0].split("`")[0].strip().partition(" ")[2])]
        elif m := GO_STRUCT.match(line):
            struct = "" if line.rstrip().endswith("}") else m[1]
        elif m := GO_FUNC.match(line):
            found += [(f"{m[1]}.{m[2]}" if m[1] else m[2], t) for t in ([m[1]] if m[1] else []) + GO_TYPE.findall(m[3].rsplit("{", 1)[0])]
    return list(dict.fromkeys(found))


def types_of(language: str, text: str) -> list[tuple[str, str]]:
    try:
        return python_types(text) if language == "python" else go_types(text) if language == "go" else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def symbols_of(path: str, text: str) -> tuple[str, list[Symbol], list[Call], list[str]]:
    language = LANGUAGES.get(re.sub(r"^.*(\.[^./]+)$", r"\1", path), "")
    if not language:
        return "", [], [], []
    try:
        return (language, *(python_symbols(text) if language == "python" else pattern_symbols(text, language)))
    except (SyntaxError, ValueError, RecursionError):
        return language, [], [], []


def extract(tree: DataFrame, project: str) -> DataFrame:
    """Rows of all that code files (path, content) hold: what ('node', 'edge', 'call', 'type', 'import'), and the columns it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (content or b"").decode("utf-8", "replace")
                language, symbols, calls, imports = symbols_of(path, text)
                if not language:
                    continue
                file = f"{project}/{path}"
                rows.append(("node", file, "", "code:file", path, language, path, 0, 0.4))
                if language == "go" and (m := GO_PACKAGE.search(text)):  # a directory's files make a package, which imports what they do
                    folder = path.rpartition("/")[0]
                    package = f"{project}/pkg/{folder or m[1]}"
                    rows.append(("node", package, "", "code:package", m[1], language, folder, 0, 0.6))
                    rows.append(("edge", package, file, "defines", "", language, path, 0, 1.0))
                    rows += [("edge", package, f"{project}/pkg/{x}", "imports", "", language, path, 0, 1.0) for x in dict.fromkeys(imports)]
                own = {name: f"{file}#{name}" for _, name, _ in symbols}
                for kind, name, line in symbols:
                    rows.append(("node", own[name], "", f"code:{kind}", name, language, path, line, 0.7))
                    rows.append(("edge", file, own[name], "defines", "", language, path, line, 1.0))
                for caller, callee, receiver, line, new in calls:
                    source = own.get(caller, file)
                    if callee in own and not receiver and own[callee] != source:
                        rows.append(("edge", source, own[callee], "calls", "", language, path, line, 1.0))
                    elif callee not in own:
                        rows.append(("call", source, callee, "new" if new else "member" if receiver else "plain", receiver, language, path, line, 0.0))
                rows += [("type", own[symbol], t, "references", "", language, path, 0, 1.0) for symbol, t in types_of(language, text) if symbol in own]
                rows += [("import", file, x, "imports", "", language, path, 0, 1.0) for x in dict.fromkeys(imports)]
            types = [pa.string()] * 7 + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["what", "a", "b", "kind", "name", "language", "path", "line", "weight"])

    return tree.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "what string, a string, b string, kind string, name string, language string, path string, line int, weight double")


def nodes(found: DataFrame) -> DataFrame:
    return found.where("what = 'node'").select(F.col("a").alias("id"), F.col("kind").alias("node_type"), F.col("name").alias("title"), "language", F.col("path").alias("source_path"), F.col("weight").alias("importance"))


def edges(found: DataFrame) -> DataFrame:
    return found.where("what = 'edge'").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("kind").alias("edge_type"), F.col("weight").alias("confidence")).distinct()


def raw_calls(found: DataFrame) -> DataFrame:
    return found.where("what = 'call'").select(F.col("b").alias("callee_name"), F.col("a").alias("caller_node_id"), F.col("path").alias("source_file"), F.col("line").cast("string").alias("source_loc"), F.col("language").alias("lang"), (F.col("kind") == "member").alias("is_member_call"), (F.col("kind") == "new").alias("is_new_call"), F.col("name").alias("receiver"))


def type_references(found: DataFrame) -> DataFrame:
    """References edges from symbols to the types that they name; a name that several types of a language have means the one of its own file, else none."""
    kinds = found.where("what = 'node' AND kind = 'code:type'").select(F.col("a").alias("to_id"), F.col("name").alias("b"), "language", F.col("path").alias("target"))
    hit = found.where("what = 'type'").select("a", "b", "language", "path").join(kinds, ["b", "language"]).where("a <> to_id")
    best = hit.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.when(F.col("path") == F.col("target"), F.col("to_id"))).alias("own"), F.min("to_id").alias("only"))
    best = best.withColumn("to_id", F.coalesce("own", F.when(F.col("n") == 1, F.col("only")))).where("to_id IS NOT NULL")
    return best.select(F.col("a").alias("from_id"), "to_id", F.lit("references").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("confidence_tier")).distinct()


def import_edges(found: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Imports edges between files, for imports by a relative path or an alias."""
    from .files import resolve_imports

    wanted = found.where("what = 'import'").select("path", F.col("b").alias("specifier"), F.col("a").alias("from_id"))
    files = found.where("what = 'node' AND kind = 'code:file'").select("path", F.col("a").alias("to_id"))
    hit = resolve_imports(wanted.select("path", "specifier"), files.select("path"), aliases=aliases)
    return wanted.join(hit, ["path", "specifier"]).join(files.withColumnRenamed("path", "target"), "target").select("from_id", "to_id", F.lit("imports").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit("EXTRACTED").alias("confidence_tier"), F.col("path").alias("file"), F.col("target").alias("target_file")).distinct()


def graph_of(tree: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the code of a tree: definitions, calls within and across files, type references, imports."""
    from ..operators.link import resolve_calls
    from ..tables import written
    from .files import clean, path_aliases

    found = written(extract(clean(tree), project), "symbols")  # read by each kind of edge
    own = nodes(found).dropDuplicates(["id"]).select("id", F.lit(project).alias("project_id"), "node_type", "title", F.lit("").alias("content"), F.lit("code").alias("source_adapter"), "source_path", "importance", "language")
    imported = import_edges(found, path_aliases(tree))
    calls = raw_calls(found).select(F.col("caller_node_id").alias("caller"), F.col("callee_name").alias("callee"), "lang", F.col("source_file").alias("file"))
    symbols = own.where("node_type <> 'code:file'").select("id", F.col("title").alias("label"), F.col("language").alias("lang"), F.col("source_path").alias("file"))
    columns = ["from_id", "to_id", "edge_type", "confidence", "confidence_tier"]
    all_ = edges(found).withColumn("confidence_tier", F.lit("EXTRACTED"))
    for more in (type_references(found), imported, resolve_calls(calls, symbols, imported.select("file", "target_file").distinct())):
        all_ = all_.unionByName(more.select(*columns))
    return own, all_
