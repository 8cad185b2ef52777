"""Facts: the one table between source text and a graph.

An extractor of any language may fill it; the passes below add what text alone shows. All
are made file by file, so a changed file's facts replace its old ones and nothing else.

| kind | name | qualified_name | label | owner | detail | extra |
|---|---|---|---|---|---|---|
| file | | | | | | |
| error | kind of error | | | | message | |
| definition | name | its own | node label | class, of members | docstring | decorators |
| body | language | definition's | its label | module | text | decorators as written |
| import | local name | what it means | | module | module | |
| call, base, raise, read, write, type | as written | | | where | module | |
| typed_call | as written | target, by types | strategy | where | module | |
| assign | variable | callee or type, as written | | where | module | |
| returns | class, as written | function's | | | module | |
| env | variable read | | | where | | |
| route | router's variable | function's | method | module | path | protocol |
| mount | router, or function called | | router or call | where | prefix | |
| handler | as written | | method | where | path | module |
| site | method | | label of the source | where | path | async |
| mention | | | | where | file name | |
| setter | variable set | | | module or file | | |
| key | name | its own | | | value | |
| infra | key | item | kind of fact | | value | |

`where` is the qualified name of the definition, or of the module. start_line and end_line
are of definitions, keys and infra facts. Bodies are read once and not kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import any_of, base_name, module_qn
from ..model import schema_of
from ..operators import config, derive, go_routes, http
from ..sources import infra
from ..sources.files import FACTS, python_facts
from ..sources.text import env_bindings
from ..storage import cutter

FACT_SCHEMA = schema_of(FACTS)
KINDS = (
    "file", "error", "definition", "body", "import", "call", "base", "raise", "read", "write", "type", "typed_call", "assign", "returns", "env",
    "route", "mount", "handler", "site", "mention", "setter", "key", "infra",
)
#: Names of files whose lines set URLs.
SETS_URLS = r"^dockerfile|\.dockerfile$|^\.env|\.(env|ya?ml|hcl|tf|sh|bash|toml|properties)$"
#: Languages whose routes stand in decorators, annotations or attributes.
MARKED = ("python", "java", "rust", "csharp")
_KEYS = ["project", "rel_path"]


def checked(facts: DataFrame) -> DataFrame:
    """Facts of any extractor, in the contract's columns; ValueError for missing columns, for
    kinds that the contract doesn't have and for files that no `file` fact names."""
    missing = [f.name for f in FACT_SCHEMA if f.name not in facts.columns]
    if set(missing) & {"project", "rel_path", "kind"}:
        raise ValueError(f"facts lack the columns {', '.join(missing)}")
    plain = facts.select(*((F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA))
    wrong = [r["kind"] for r in plain.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | F.col("project").isNull() | F.col("rel_path").isNull()).select(F.coalesce("kind", F.lit("null")).alias("kind")).distinct().limit(5).collect()]
    if wrong:
        raise ValueError(f"facts of unknown kinds, projects or files: {', '.join(wrong)}")
    lost = plain.join(plain.where("kind = 'file'").select(*_KEYS), _KEYS, "left_anti").select("rel_path").first()
    if lost:
        raise ValueError(f"no file fact for {lost['rel_path']}")
    empty = {"string": F.lit(""), "int": F.lit(0), "array<string>": F.array().cast("array<string>")}
    return plain.select(*(F.coalesce(f.name, empty[f.dataType.simpleString()]).alias(f.name) for f in FACT_SCHEMA))


def fact(rows: DataFrame, kind: str, **given: Column | str) -> DataFrame:
    """Rows as facts of a kind; columns not given are empty."""
    empty = {"string": F.lit(""), "int": F.lit(0), "array<string>": F.array().cast("array<string>")}
    value = lambda f: F.col(f.name) if f.name in _KEYS else F.lit(kind) if f.name == "kind" else F.coalesce(F.col(given[f.name]) if isinstance(given[f.name], str) else given[f.name], empty[f.dataType.simpleString()]) if f.name in given else empty[f.dataType.simpleString()]
    return rows.select(*(value(f).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA))


def _code_facts(bodies: DataFrame, has_go: bool) -> list[DataFrame]:
    """Facts that the text of definitions shows: routes, handlers, call sites, file names,
    variables that are set."""
    b = bodies.select(*_KEYS, F.col("owner").alias("module_qn"), "qualified_name", "label", F.col("name").alias("language"), F.col("detail").alias("text"), F.array_join("extra", "\n").alias("marks"))
    functions = b.where("label in ('Function', 'Method')")
    sources = functions.withColumn("text", F.when(F.col("language").isin(*MARKED), F.col("marks")).otherwise(F.col("text"))).drop("marks", "label")
    routes = http.extract_routes(sources.where("language <> 'go'"))
    out = [fact(routes, "route", name="router", qualified_name="qualified_name", label="method", owner="module_qn", detail="path", extra=F.array("protocol"))]
    refs = http.handler_refs(functions.where("language <> 'go'").drop("marks", "label", "language"))
    out.append(fact(refs, "handler", name="handler", owner="qualified_name", detail="path", extra=F.array("module_qn")))
    if has_go:
        go = functions.where("language = 'go'")
        where = go.select(*_KEYS, "qualified_name", "module_qn")
        rows = go_routes.tokens(go.select("qualified_name", "text"))
        found = go_routes.go_routes(go, rows).join(where, "qualified_name")
        # A route that names its handler is a registration; the path without one is the function's own.
        named = found.where("handler <> ''")
        out.append(fact(named, "handler", name="handler", label="method", owner="qualified_name", detail="path", extra=F.array("module_qn")))
        out.append(fact(found.where("handler = ''"), "route", name="variable", qualified_name="qualified_name", label="method", owner="module_qn", detail="path", extra=F.array(F.lit("http"))))
        mounts = go_routes.go_mounts(go, rows).join(where, "qualified_name")
        out.append(fact(mounts, "mount", name="callee", label=F.lit("call"), owner="qualified_name", detail="prefix", extra=F.array("module_qn")))
    constants = b.where("label = 'Variable'").select(*_KEYS, F.col("module_qn").alias("qualified_name"), F.lit("Module").alias("label"), "text")
    sites = http.call_sites(functions.select(*_KEYS, "qualified_name", "label", "text").unionByName(constants))
    out.append(_sites(sites))
    out.append(_setters(constants))
    names = F.regexp_extract_all("text", F.lit(config.FILE_NAMES), F.lit(1))
    out.append(fact(functions.select(*_KEYS, "qualified_name", F.explode(F.array_distinct(names)).alias("value")), "mention", owner="qualified_name", detail="value"))
    shown = http.protocol("text")
    out.append(fact(functions.select(*_KEYS, "qualified_name", shown.alias("protocol")).where("protocol <> ''"), "mention", owner="qualified_name", label=F.lit("protocol"), detail="protocol"))
    return out


def _sites(sites: DataFrame) -> DataFrame:
    queue = F.when(F.col("is_async"), F.array(F.lit("async"))).otherwise(F.array().cast("array<string>"))
    return fact(sites, "site", name="method", label="source_label", owner="source_qualified_name", detail="path", extra=queue)


def _setters(texts: DataFrame) -> DataFrame:
    rows = texts.withColumn("name", derive.set_key("text")).where(derive.is_env_name("name"))
    return fact(rows.select(*_KEYS, "name", "qualified_name").distinct(), "setter", name="name", owner="qualified_name")


def extract(files: DataFrame, cut=None) -> DataFrame:
    """Facts of files (project, rel_path, text). `cut` writes a table and gives it back."""
    cut = cut or cutter(files.sparkSession, "facts")
    files = cut("files", files.select(*_KEYS, "text"))
    name = F.lower(base_name("rel_path"))
    kinds = {
        "code": F.endswith(name, F.lit(".py")), "config": config.is_config("rel_path") | base_name("rel_path").isin(*config.MANIFESTS), "urls": name.rlike(SETS_URLS), "compose": infra.is_compose("rel_path"), "cloudbuild": infra.is_cloudbuild("rel_path"), "terraform": infra.is_terraform("rel_path"),
        "lines": name.rlike(r"^dockerfile|\.dockerfile$|^\.env|\.env$|\.(sh|bash|zsh)$"), "router": any_of([F.contains("text", F.lit(w)) for w in ("include_router", ".use(", "prefix")]),
    }
    there = files.agg(*(F.coalesce(F.max(v), F.lit(False)).alias(k) for k, v in kinds.items())).first()  # what there is none of isn't planned
    out = [fact(files, "file")]
    if there["code"]:
        out.append(cut("code", with_code(python_facts(files, errors=True), cut, python_only=True)))
    if there["router"]:
        modules = files.where(F.endswith("rel_path", F.lit(".py")) | F.col("rel_path").rlike(r"\.[cm]?[jt]sx?$")).select(*_KEYS, module_qn("project", "rel_path").alias("qualified_name"), "text")
        out.append(fact(http.group_prefixes(modules), "mount", name="variable", label=F.lit("router"), owner="qualified_name", detail="prefix"))
    if there["urls"]:
        urls = env_bindings(files.where(name.rlike(SETS_URLS))).select(*_KEYS, F.concat(module_qn("project", "rel_path"), F.lit(".__file__")).alias("qualified_name"), F.lit("Module").alias("label"), F.concat_ws(" = ", "key", "value").alias("text"))
        out += [_sites(http.call_sites(urls)), _setters(urls)]
    if there["config"]:
        out.append(fact(config.config_variables(files), "key", name="name", qualified_name="qualified_name", start_line="start_line", end_line="start_line", detail="value"))
    for kind, found in (("lines", infra.line_facts), ("compose", infra.compose_facts), ("cloudbuild", infra.cloudbuild_facts), ("terraform", infra.terraform_facts)):
        if there[kind]:
            out.append(fact(found(files).dropDuplicates(), "infra", name="key", qualified_name="item", label="kind", detail="value", start_line=F.col("line").cast("int")))
    return reduce(DataFrame.unionByName, out)


def with_code(facts: DataFrame, cut=None, python_only: bool = False) -> DataFrame:
    """Facts without bodies, and with what their text shows instead."""
    cut = cut or cutter(facts.sparkSession, "facts")
    facts = cut("raw", facts)
    bodies = facts.where("kind = 'body'")
    has_go = not python_only and not bodies.where("name = 'go'").isEmpty()
    return reduce(DataFrame.unionByName, [facts.where("kind <> 'body'"), *_code_facts(bodies, has_go)])
