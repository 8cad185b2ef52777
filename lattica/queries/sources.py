"""Source text and facts: files that Spark writes out of the given tables, and what the
extractors, the index and the change frontier make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import derive, go_routes
from ..plans import facts as facts_table, index as plan
from ..sources import infra
from ..sources.star import table

_P = "p"


def _text(template: str) -> Column:
    """A text with the columns that stand in {} in it."""
    parts = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0"))]
    return F.concat(*parts)


def _nations(s: SparkSession, d: str, line: str, *, first: str = "", last: str = "") -> DataFrame:
    """(n, r, text) of a text for each nation that has suppliers: `first`, a line for each of
    its suppliers, `last`. Columns of lines are n, r and k, of the ends n and r. In lines « and »
    stand for braces."""
    some = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")).join(table(s, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r")), "n")
    body = some.groupBy("n", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", _text(line).alias("t")))), lambda x: x["t"]), "").alias("body"))  # suppliers of a nation, as a file holds them
    return body.select("n", "r", F.translate(F.concat(_text(first), F.col("body"), _text(last)), "«»", "{}").alias("text"))


def _go_blocks(s: SparkSession, d: str) -> DataFrame:
    """Routes in nested blocks: nations in regions, suppliers in nations."""
    inner = _nations(s, d, '\t\t\tr.Post("/s{k}", addS{k}) // »\n', first='\t\tr.Route("/n{n}", func(r chi.Router) «\n\t\t\tr.Get("/", listN{n})\n', last="\t\t})\n".replace("}", "»"))
    body = inner.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("body"))
    text = F.concat(F.translate(_text('func SetupR{r}(r chi.Router) «\n\tr.Route("/r{r}", func(r chi.Router) «\n'), "«", "{"), "body", F.translate(_text('\t»)\n\tr.Get("/out{r}", out)\n»\n'), "»", "}"))
    found = go_routes.go_routes(body.select(_text("SetupR{r}").alias("qualified_name"), text.alias("text")))
    return found.select("qualified_name", "method", "path", "handler")


def _go_groups(s: SparkSession, d: str) -> DataFrame:
    """Routes of groups and of groups of groups, and functions that a group is handed to."""
    texts = _nations(s, d, '\tw.POST("s{k}", check, h{k})\n\tm{k}(v)\n', first='func N{n}(rg *gin.RouterGroup) «\n\tv := rg.Group("/n{n}")\n\tw := v.Group("/more/")\n\tv.GET("", listN{n})\n\trg.GET("/own{n}", own)\n', last="\tOther(w.Group(\"last\"))\n»\n")
    sources = texts.select(_text("N{n}").alias("qualified_name"), "text")
    routes = go_routes.go_routes(sources).select("qualified_name", F.lit("route").alias("kind"), F.concat_ws(" ", "method", "variable", "handler").alias("name"), "path")
    return routes.unionByName(go_routes.go_mounts(sources).select("qualified_name", F.lit("mount").alias("kind"), F.col("callee").alias("name"), F.col("prefix").alias("path")))


def _files(rows: DataFrame, path: str) -> DataFrame:
    return rows.select(F.lit(_P).alias("project"), _text(path).alias("rel_path"), "text")


def _compose(s: SparkSession, d: str) -> DataFrame:
    line = '  s{k}:\n    image: "repo/s{k}:{n}"  # tag\n    ports:\n    - "{k}:80"\n    - 9{k}\n    environment:\n      SIZE: \'{k}\'\n      API_TOKEN: x\n    depends_on: [db, "cache{n}"]\n    build:\n      context: ./s{k}\n\n'
    files = _files(_nations(s, d, line, first="version: '3'\nservices:\n", last="  db:\n    environment:\n      - REGION={r}\n      - PASSWORD=y\nnetworks:\n  net: «»\n"), "deploy/n{n}/docker-compose.yml")
    return infra.compose_facts(files).select("rel_path", "item", "kind", "key", "value")


def _terraform(s: SparkSession, d: str) -> DataFrame:
    line = 'variable "s{k}" «\n  type    = string # «\n  default = "v{k}"\n  validation «\n    description = "inner"\n  »\n»\n\nresource "aws_thing" "r{k}" «\n  name = "«x»"\n  source = "not/a/module"\n»\n'
    files = _files(_nations(s, d, line, first='terraform «\n  backend "s{n}" «\n    bucket = "b"\n  »\n»\n', last='module "m{n}" « source = "./modules/m{n}" »\nlocals «\n  a = 1\n»\n'), "infra/n{n}.tf")
    return infra.terraform_facts(files).select("rel_path", "kind", "key", "value")


def _yaml(s: SparkSession, d: str) -> DataFrame:
    """Paths of a nested file: keys at the level of their list, items that are maps."""
    files = _files(_nations(s, d, "  - name: s{k}\n    args: [a, b]\n    env:\n    - k{k}\n", first="top:\n  inner:\n    leaf: {r}\nsteps:\n", last="end: {n}\n"), "n{n}.yaml")
    rows = infra.yaml_paths(files)
    path = F.array_join(F.transform("path", lambda p: F.regexp_replace(p, "^-.*$", "-")), "/")
    return rows.select("rel_path", "line", path.alias("path"), "key", "value")


def _python_files(s: SparkSession, d: str) -> DataFrame:
    """A module for each nation, with a function for each of its suppliers, and what they share."""
    line = '«m{k}»def supplier_{k}(x: Base) -> Base:\n«w{k}»    return os.getenv("N{n}_URL"), helper\n\n'
    rows = _nations(s, d, line, first='import os\nfrom shared.base import Base, helper\n\nN{n}_URL = "u"\nLIMIT_{n} = 1\n\n').withColumn("text", F.col("text"))
    # Every third supplier has a route, every second sets the limit.
    marked = F.regexp_replace("text", r"\{m(\d*[0-9])\}def supplier_(\d+)\(", "{m$1}def supplier_$2(")
    lines = rows.select("n", F.posexplode(F.split(marked, "\n")).alias("at", "line"))
    key = F.regexp_extract("line", r"^\{[mw](\d+)\}", 1).cast("long")
    body = F.regexp_replace("line", r"^\{[mw]\d+\}", "")
    limit = F.concat(F.lit("    global LIMIT_"), F.col("n").cast("string"), F.lit("\n    LIMIT_"), F.col("n").cast("string"), F.lit(" = 2\n"), body)
    mark = F.concat(F.lit('@app.get("/n'), F.col("n").cast("string"), F.lit("/s"), key.cast("string"), F.lit('")\n'), body)
    new = F.when(F.startswith("line", F.lit("{m")) & (key % 3 == 0), mark).when(F.startswith("line", F.lit("{w")) & (key % 2 == 0), limit).otherwise(body)
    text = lines.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", new.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    shared = s.createDataFrame([(_P, "shared/base.py", "class Base:\n    pass\n\ndef helper():\n    return 1\n")], "project string, rel_path string, text string")
    return _files(text, "nations/n{n}.py").unionByName(shared)


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """Edges of an index of those files, by names."""
    graph = plan.index(_python_files(s, d))
    ends = lambda side: graph.nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(f"{side}_qn"))
    some = graph.edges.where("type in ('USAGE', 'WRITES', 'USES_TYPE', 'CONFIGURES', 'HANDLES', 'DEFINES', 'IMPORTS', 'CALLS')")
    return some.join(ends("source"), "source_id").join(ends("target"), "target_id").select("type", "source_qn", "target_qn")


def _return_types(s: SparkSession, d: str) -> DataFrame:
    """Each nation is a class, whose method `step` returns another one, but in region 4;
    each supplier has a chain of variables, the first of its nation."""
    nations, suppliers = table(s, d, "nation"), table(s, d, "supplier")
    name = lambda c: F.concat(F.lit("N"), c.cast("string"))
    known = nations.select(F.lit(_P).alias("project"), F.concat(F.lit("p.m."), name(F.col("n_nationkey"))).alias("qualified_name"), name(F.col("n_nationkey")).alias("name"), F.lit("Class").alias("label"))
    returns = nations.where("n_regionkey <> 4").select(F.lit(_P).alias("project"), F.concat(F.lit("p.m."), name(F.col("n_nationkey")), F.lit(".step")).alias("qualified_name"), name((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("type_name"))
    chain = suppliers.select(F.col("s_suppkey").cast("string").alias("k"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    variable = lambda i: F.concat(F.lit("v"), F.col("k"), F.lit("_"), i.cast("string"))
    callee = F.when(F.col("i") == 0, name(F.col("s_nationkey"))).otherwise(F.concat(variable(F.col("i") - 1), F.lit(".step")))
    assigns = chain.select(F.lit(_P).alias("project"), F.concat(F.lit("p.use"), (F.col("k").cast("long") % 10).cast("string")).alias("module_qn"), variable(F.col("i")).alias("variable"), callee.alias("type_name"))
    maps = s.createDataFrame([], "project string, module_qn string, imports map<string,string>")
    return derive.variable_types(assigns, returns, known, maps).select("variable", "class_qn")


def _facts(rows: DataFrame, kind: str, **given) -> DataFrame:
    return facts_table.fact(rows.withColumn("project", F.lit(_P)), kind, **given)


def _frontier(s: SparkSession, d: str) -> DataFrame:
    """Suppliers are functions, a file for each nation; customers call them by number, a file
    for each segment and nation. Some suppliers go, some become methods."""
    suppliers = table(s, d, "supplier").select(F.concat(F.lit("s/n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("rel_path"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    customers = table(s, d, "customer").select(F.concat(F.lit("c/"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit(".py")).alias("rel_path"), F.concat(F.lit("lib.f"), (F.col("c_custkey") % 500).cast("string")).alias("name"))
    qn = F.concat(F.lit("p.s."), F.col("name"))
    old = _facts(suppliers, "definition", name="name", qualified_name=qn, label=F.lit("Function"))
    moved = F.col("s_suppkey") % 50 == 7
    new = _facts(suppliers.where("s_suppkey % 40 <> 3"), "definition", name="name", qualified_name=qn, label=F.when(moved, "Method").otherwise("Function"))
    every = new.unionByName(_facts(customers, "call", name="name"))
    changed = suppliers.where("s_suppkey % 40 = 3 or s_suppkey % 50 = 7").select(F.lit(_P).alias("project"), "rel_path").distinct()
    return plan.affected_files(every, changed, plan.changed_names(old, new, every)).select("rel_path")


QUERIES = {
    "go_block_routes": _go_blocks,
    "go_group_routes": _go_groups,
    "compose_facts": _compose,
    "terraform_facts": _terraform,
    "yaml_paths": _yaml,
    "index_python_files": _indexed,
    "return_types": _return_types,
    "change_frontier": _frontier,
}

_S = "(SELECT s_suppkey AS k, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_N = f"(SELECT DISTINCT n, r FROM {_S})"

SQL = {
    "go_block_routes": f"""
SELECT 'SetupR' || r AS qualified_name, 'POST' AS method, '/r' || r || '/n' || n || '/s' || k AS path, 'addS' || k AS handler FROM {_S}
UNION ALL SELECT 'SetupR' || r, 'GET', '/r' || r || '/n' || n, 'listN' || n FROM {_N}
UNION ALL SELECT DISTINCT 'SetupR' || r, 'GET', '/out' || r, 'out' FROM {_N}""",
    "go_group_routes": f"""
SELECT 'N' || n AS qualified_name, 'route' AS kind, 'POST rg h' || k AS name, '/n' || n || '/more/s' || k AS path FROM {_S}
UNION ALL SELECT 'N' || n, 'route', 'GET rg listN' || n, '/n' || n FROM {_N} UNION ALL SELECT 'N' || n, 'route', 'GET rg own', '/own' || n FROM {_N}
UNION ALL SELECT 'N' || n, 'mount', 'm' || k, '/n' || n FROM {_S} UNION ALL SELECT 'N' || n, 'mount', 'Other', '/n' || n || '/more/last' FROM {_N}""",
    "compose_facts": f"""
WITH f AS (SELECT *, 'deploy/n' || n || '/docker-compose.yml' AS p, 's' || k AS i FROM {_S}), e AS (SELECT *, 'deploy/n' || n || '/docker-compose.yml' AS p FROM {_N})
SELECT p AS rel_path, i AS item, 'service' AS kind, i AS key, '' AS value FROM f UNION ALL SELECT p, i, 'image', '', 'repo/s' || k || ':' || n FROM f
UNION ALL SELECT p, i, 'ports', '', k || ':80' FROM f UNION ALL SELECT p, i, 'ports', '', '9' || k FROM f UNION ALL SELECT p, i, 'environment', 'SIZE', CAST(k AS VARCHAR) FROM f
UNION ALL SELECT p, i, 'depends_on', '', 'db' FROM f UNION ALL SELECT p, i, 'depends_on', '', 'cache' || n FROM f UNION ALL SELECT p, i, 'build_context', '', './s' || k FROM f
UNION ALL SELECT p, 'db', 'service', 'db', '' FROM e UNION ALL SELECT p, 'db', 'environment', 'REGION', CAST(r AS VARCHAR) FROM e""",
    "terraform_facts": f"""
WITH f AS (SELECT *, 'infra/n' || n || '.tf' AS p FROM {_S}), e AS (SELECT *, 'infra/n' || n || '.tf' AS p FROM {_N})
SELECT p AS rel_path, 'variable' AS kind, 's' || k AS key, '' AS value FROM f UNION ALL SELECT p, 'variable_type', 's' || k, 'string' FROM f UNION ALL SELECT p, 'variable_default', 's' || k, 'v' || k FROM f
UNION ALL SELECT p, 'resource', 'aws_thing', 'r' || k FROM f UNION ALL SELECT p, 'backend', '', 's' || n FROM e UNION ALL SELECT p, 'module', 'm' || n, '' FROM e
UNION ALL SELECT p, 'module_source', 'm' || n, './modules/m' || n FROM e UNION ALL SELECT p, 'locals', '', 'true' FROM e""",
    "yaml_paths": f"""
WITH f AS (SELECT *, 'n' || n || '.yaml' AS p, 4 + 4 * (row_number() OVER (PARTITION BY n ORDER BY k) - 1) AS b FROM {_S}), e AS (SELECT n, r, p, max(b) + 5 AS z FROM f GROUP BY ALL), x AS (
  SELECT p, 1 AS line, '' AS path, 'top' AS key, '' AS value FROM e UNION ALL SELECT p, 2, 'top', 'inner', '' FROM e UNION ALL SELECT p, 3, 'top/inner', 'leaf', CAST(r AS VARCHAR) FROM e UNION ALL SELECT p, 4, '', 'steps', '' FROM e
  UNION ALL SELECT p, b + 1, 'steps', '-', '' FROM f UNION ALL SELECT p, b + 1, 'steps/-', 'name', 's' || k FROM f UNION ALL SELECT p, b + 2, 'steps/-', 'args', '[a, b]' FROM f
  UNION ALL SELECT p, b + 3, 'steps/-', 'env', '' FROM f UNION ALL SELECT p, b + 4, 'steps/-/env', '-', 'k' || k FROM f UNION ALL SELECT p, z, '', 'end', CAST(n AS VARCHAR) FROM e)
SELECT p AS rel_path, CAST(line AS INTEGER) AS line, path, key, value FROM x""",
    "index_python_files": f"""
WITH f AS (SELECT *, 'p.nations.n' || n AS m, 'p.nations.n' || n || '.supplier_' || k AS q FROM {_S}), e AS (SELECT *, 'p.nations.n' || n AS m FROM {_N})
SELECT 'USES_TYPE' AS type, q AS source_qn, 'p.shared.base.Base' AS target_qn FROM f UNION ALL SELECT 'USAGE', q, 'p.shared.base.' || x FROM f, (VALUES ('Base'), ('helper')) t(x) UNION ALL SELECT 'WRITES', q, m || '.LIMIT_' || n FROM f WHERE k % 2 = 0
UNION ALL SELECT 'CONFIGURES', m || '.N' || n || '_URL', q FROM f UNION ALL SELECT 'CONFIGURES', m, q FROM f UNION ALL SELECT 'HANDLES', q, 'p.__route__.GET./n' || n || '/s' || k FROM f WHERE k % 3 = 0
UNION ALL SELECT 'DEFINES', m, q FROM f UNION ALL SELECT 'DEFINES', m, m || '.N' || n || '_URL' FROM e UNION ALL SELECT 'DEFINES', m, m || '.LIMIT_' || n FROM e
UNION ALL SELECT 'DEFINES', 'p.shared.base', 'p.shared.base.' || x FROM (VALUES ('Base'), ('helper')) t(x) UNION ALL SELECT 'IMPORTS', m, 'p.shared.base.' || x FROM e, (VALUES ('Base'), ('helper')) t(x)""",
    "return_types": """
WITH RECURSIVE c AS (
  SELECT s_suppkey AS k, 0 AS i, CAST(s_nationkey AS BIGINT) AS n FROM supplier
  UNION ALL SELECT k, i + 1, CAST((n_nationkey * 7 + n_regionkey) % 25 AS BIGINT) FROM c JOIN nation ON n_nationkey = n WHERE n_regionkey <> 4 AND i < 4
) SELECT 'v' || k || '_' || i AS variable, 'p.m.N' || n AS class_qn FROM c""",
    "change_frontier": """
WITH x AS (SELECT s_suppkey AS k, 's/n' || s_nationkey || '.py' AS p FROM supplier WHERE s_suppkey % 40 = 3 OR s_suppkey % 50 = 7)
SELECT p AS rel_path FROM x UNION SELECT 'c/' || lower(c_mktsegment) || c_nationkey || '.py' FROM customer WHERE c_custkey % 500 IN (SELECT k FROM x)""",
}
