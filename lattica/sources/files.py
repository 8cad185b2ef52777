"""Source files: discovery with ignore rules, and facts of Python files."""

from __future__ import annotations

import ast
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import base_name
from ..storage import Cuts

#: Folders and suffixes that are never looked at.
IGNORED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "vendor", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea", ".vscode", ".tox", ".mypy_cache", ".pytest_cache", "coverage", ".next", ".cache")
IGNORED_SUFFIXES = (".min.js", ".min.css", ".map", ".lock", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".zip", ".gz", ".tar", ".jar", ".class", ".so", ".dll", ".exe", ".pyc", ".wasm", ".woff", ".woff2", ".ttf")
#: Bytes of files that a worker reads before it hands them on.
READ_BYTES = 32_000_000


#: Entries that a worker lists before it hands the folders left on to other workers.
LISTED_ENTRIES = 20_000
#: Bytes at a file's start in which a zero byte shows that it is no text.
SNIFF_BYTES = 8192
IGNORE_FILE = ".gitignore"


def _uri(root: str) -> str:
    return (root if "://" in root else f"file://{os.path.abspath(root)}").rstrip("/")


def list_files(spark: SparkSession, root: str, most_bytes: int | None = None, entries: int = LISTED_ENTRIES) -> DataFrame:
    """(rel_path, size, mtime_ns) of the files below a folder, without what ignore rules
    name. Workers list folders, and hand those left after `entries` entries on; each folder
    carries the rules of the folders above it, so an ignored folder is never entered. The
    driver holds counts only."""
    uri = _uri(root)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        schema = pa.schema([("rel_path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("rules", pa.string())])
        for batch in batches:
            open_ = [(r["rel_path"], json.loads(r["rules"])) for r in batch.to_pylist()]
            out, seen = [], 0
            while open_ and seen < entries:
                folder, texts = open_.pop()
                inside = f"{folder}/" if folder else ""
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                seen += len(found)
                if any(f.base_name == IGNORE_FILE for f in found):
                    with system.open_input_stream(f"{base}/{inside}{IGNORE_FILE}", compression=None) as file:
                        texts = [*texts, [inside, file.read().decode(errors="replace")]]
                rules = [(at, IgnoreRules(text.split("\n"))) for at, text in texts]
                for f in found:
                    path, is_folder = inside + f.base_name, f.type == fs.FileType.Directory
                    if f.base_name in IGNORED_FOLDERS if is_folder else f.base_name.lower().endswith(IGNORED_SUFFIXES):
                        continue
                    if any(own.hides(path[len(at) :], is_folder) for at, own in rules):
                        continue
                    if is_folder:
                        open_.append((path, texts))
                    elif most_bytes is None or f.size <= most_bytes:
                        out.append({"rel_path": path, "size": f.size, "mtime_ns": f.mtime_ns or 0, "rules": None})
            out += [{"rel_path": folder, "size": None, "mtime_ns": None, "rules": json.dumps(texts)} for folder, texts in open_]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    cuts, files = Cuts(spark, "discover"), None
    folders = spark.createDataFrame([("", "[]")], "rel_path string, rules string")
    while True:
        listed = cuts.cut(folders.mapInArrow(walk, "rel_path string, size long, mtime_ns long, rules string"))
        here = listed.where("rules is null").drop("rules")
        files = here if files is None else files.unionByName(here)
        folders = listed.where("rules is not null").select("rel_path", "rules")
        left = folders.count()
        if not left:
            return files
        folders = folders.repartition(min(left, 4 * spark.sparkContext.defaultParallelism))


def read_texts(root: str, paths: DataFrame) -> DataFrame:
    """(rel_path, text, size, mtime_ns, sha256) of files (rel_path, size, mtime_ns). What
    isn't UTF-8 is read with replacement characters; files that hold zero bytes at their
    start are no texts and are left out, as are files that are gone."""
    uri = _uri(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        schema = pa.schema([("rel_path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("text", pa.string()), ("sha256", pa.string())])
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                try:
                    with system.open_input_stream(f"{base}/{row['rel_path']}", compression=None) as file:
                        data = file.read()
                except FileNotFoundError:
                    continue
                if b"\0" in data[:SNIFF_BYTES]:
                    continue
                out.append({**row, "text": data.decode(errors="replace"), "sha256": hashlib.sha256(data).hexdigest()})
                held += len(data)
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = paths.select("rel_path", "size", "mtime_ns").mapInArrow(read, "rel_path string, size long, mtime_ns long, text string, sha256 string")
    return found.select("rel_path", "text", "size", "mtime_ns", "sha256")


def discover(spark: SparkSession, root: str, project: str, most_bytes: int | None = None) -> DataFrame:
    """(project, rel_path, text, size, mtime_ns, sha256) of the text files below a folder;
    `most_bytes` leaves out larger files, by default none."""
    found = read_texts(root, list_files(spark, root, most_bytes))
    return found.select(F.lit(project).alias("project"), "rel_path", "text", "size", "mtime_ns", "sha256")


class IgnoreRules:
    """Patterns of ignore files: the last one that fits decides, `!` takes back."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for line in lines:
            rule = line.rstrip("\n").rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.lstrip("!")
            folder, rule = rule.endswith("/"), rule.rstrip("/")
            rooted, rule = "/" in rule, rule.lstrip("/")
            wild = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
            body = "".join(wild.get(t, re.escape(t)) for t in re.findall(r"\*\*/|/\*\*$|\*\*|[*?]|[^*?]", rule))
            self.rules.append((re.compile(("" if rooted else "(?:.*/)?") + body), keep, folder))

    def hides(self, path: str, is_folder: bool) -> bool:
        """Whether a file's or a folder's own path is ignored, whatever it lies in."""
        out = False
        for pattern, keep, folder in self.rules:
            if (is_folder or not folder) and pattern.fullmatch(path):
                out = not keep
        return out

    def ignores(self, path: str) -> bool:
        """Whether a file's path, or a folder that it lies in, is ignored."""
        parts = path.split("/")
        return any(self.hides("/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1))


#: A fact of a file. What each kind holds is told in plans/facts.py.
FACTS = "project string, rel_path string, kind string, name string, qualified_name string, label string, start_line int, end_line int, owner string, detail string, extra array<string>"


def _name_of(node: ast.AST | None) -> str:
    """The dotted name of a name or an attribute, however deep; of an attribute of anything
    else () and what follows; empty for others."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return ".".join(["()", *reversed(parts)]) if parts else ""


def _written(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return ""


def _parsed(text: str) -> ast.AST | None:
    """An annotation in quotes, as an expression."""
    try:
        return ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _type_names(node: ast.AST | None) -> Iterator[tuple[str, int]]:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        node = _parsed(node.value)
    for part in ast.walk(node) if node is not None else ():
        if _name_of(part):
            yield _name_of(part), getattr(part, "lineno", 0)


def _return_type(node: ast.AST | None) -> str:
    """The one class that a return annotation names: X, "X", Optional[X] or X | None."""
    while node is not None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            node = _parsed(node.value)
        elif isinstance(node, ast.Subscript) and _name_of(node.value).split(".")[-1] == "Optional":
            node = node.slice
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            sides = [x for x in (node.left, node.right) if not (isinstance(x, ast.Constant) and x.value is None)]
            node = sides[0] if len(sides) == 1 else None
        else:
            return _name_of(node)
    return ""


def _facts(rel_path: str, project: str, text: str) -> Iterator[tuple]:
    """Facts of one Python file: definitions with their bodies, calls, imports, raises,
    reads, writes of what a function declares global or reaches by an attribute,
    environment reads, assignments of calls, annotations and returned types. Variables are
    those of modules, fields those of classes. The tree is walked by a list of open nodes,
    so its depth has no bound."""
    module = re.sub(r"(^|/)(__init__)$", "", re.sub(r"\.[^./]*$", "", rel_path)).replace("/", ".").strip(".")
    module = f"{project}.{module}" if module else project
    fact = lambda kind, name="", qn="", label="", line=0, end=0, owner="", detail="", extra=(): (project, rel_path, kind, name, qn, label, line, end, owner, detail, list(extra))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as wrong:
        yield fact("error", type(wrong).__name__, detail=str(wrong)[:200])
        return
    lines = text.split("\n")
    body = lambda qn, label, line, end, marks: fact("body", "python", qn, label, line, end, module, "\n".join(lines[line - 1 : max(line, end)]), marks)
    open_: list[tuple[ast.AST, str, str | None, frozenset[str]]] = [(child, module, None, frozenset()) for child in ast.iter_child_nodes(tree)]
    while open_:
        node, owner, inside, shared = open_.pop()
        line, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0
        below = (owner, inside, shared)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            qn, is_class = f"{owner}.{node.name}", isinstance(node, ast.ClassDef)
            label = "Class" if is_class else "Method" if inside == "class" else "Function"
            marks = [_written(d) for d in node.decorator_list]
            yield fact("definition", node.name, qn, label, line, end, owner if inside == "class" else "", ast.get_docstring(node) or "", marks)
            if is_class:
                yield from (fact("base", _name_of(b), line=line, end=end, owner=qn, detail=module) for b in node.bases if _name_of(b))
            else:
                yield body(qn, label, line, end, [f"@{m}" for m in marks])
                a = node.args
                for one in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg, node):
                    annotation = (one.returns if one is node else one.annotation) if one else None
                    yield from (fact("type", name, line=at, owner=qn, detail=module) for name, at in _type_names(annotation))
                if returned := _return_type(node.returns):
                    yield fact("returns", returned, qn, line=line, owner=qn, detail=module)
            below = (qn, "class" if is_class else "function", frozenset(n for g in ast.walk(node) if isinstance(g, ast.Global) for n in g.names))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            if inside in (None, "class"):
                label = "Field" if inside else "Variable"
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        yield fact("definition", t.id, f"{owner}.{t.id}", label, line, end, owner if inside else "")
                        if not inside:
                            yield body(f"{owner}.{t.id}", label, line, end, ())
            if isinstance(node, ast.AnnAssign):
                yield from (fact("type", name, line=at, owner=owner, detail=module) for name, at in _type_names(node.annotation))
            elif isinstance(node.value, ast.Call) and _name_of(node.value.func):
                yield from (fact("assign", t.id, _name_of(node.value.func), line=line, end=end, owner=owner, detail=module) for t in node.targets if isinstance(t, ast.Name))
        elif isinstance(node, ast.Import):
            yield from (fact("import", a.asname or a.name.split(".")[0], f"{project}.{a.name}", line=line, end=end, owner=module, detail=module) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            up = module.split(".")[: -node.level] if node.level else [project]
            base = ".".join([*up, *([node.module] if node.module else [])])
            yield from (fact("import", a.asname or a.name, f"{base}.{a.name}", line=line, end=end, owner=module, detail=module) for a in node.names)
        elif isinstance(node, ast.Call) and _name_of(node.func):
            callee = _name_of(node.func)
            yield fact("call", callee, line=line, end=end, owner=owner, detail=module)
            if callee in ("os.getenv", "os.environ.get") and node.args and isinstance(node.args[0], ast.Constant):
                yield fact("env", str(node.args[0].value), line=line, end=end, owner=owner, detail=module)
        elif isinstance(node, ast.Raise) and node.exc is not None:
            if target := _name_of(node.exc.func if isinstance(node.exc, ast.Call) else node.exc):
                yield fact("raise", target, line=line, end=end, owner=owner, detail=module)
        elif isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Store):
            yield fact("read", node.id, line=line, end=end, owner=owner, detail=module)
        elif isinstance(node, ast.Name) and node.id in shared:
            yield fact("write", node.id, line=line, end=end, owner=owner, detail=module)
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Store) and _name_of(node).split(".")[0] not in ("", "()", "self", "cls"):
            yield fact("write", _name_of(node), line=line, end=end, owner=owner, detail=module)
        open_.extend((child, *below) for child in ast.iter_child_nodes(node))


def python_facts(files: DataFrame, errors: bool = False) -> DataFrame:
    """Facts of Python files (project, rel_path, text), file by file in workers. With
    `errors` a file that can't be parsed gives a fact that says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            for project, path, text in zip(batch["project"], batch["rel_path"], batch["text"]):
                yield pd.DataFrame(list(_facts(path, project, text or "")), columns=columns)

    found = files.where(F.endswith(base_name("rel_path"), F.lit(".py"))).select("project", "rel_path", "text").mapInPandas(run, FACTS)
    return found if errors else found.where("kind <> 'error'")


def json_urls(text: str, depth: int = 20, most: int | None = 20) -> list[tuple[str, str]]:
    """(key path, URL) of a JSON text, by keys that name addresses; bounded in
    depth, and in number unless `most` is None."""
    try:
        tree = json.loads(text)
    except ValueError:
        return []
    out: list[tuple[str, str]] = []

    def walk(value: object, path: str, left: int) -> None:
        if left < 0 or (most is not None and len(out) >= most):
            return
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}".strip("."), left - 1)
        elif isinstance(value, list):
            for v in value:
                walk(v, path, left - 1)
        elif isinstance(value, str) and re.match(r"https?://|/[A-Za-z]", value) and re.search(r"(?i)(url|uri|endpoint|host|path|base|api|service|target|href)", path):
            out.append((path, value))

    walk(tree, "", depth)
    return out
