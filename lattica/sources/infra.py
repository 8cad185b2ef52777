"""Facts of infrastructure files: Dockerfiles, dotenv, shell, compose, build and Terraform.

Lines are rows. What a line belongs to is told by nesting: indentation in YAML, braces in
Terraform. Facts are (project, rel_path, item, kind, key, value, line): `item` names a
service of a compose file and is empty for the file itself. Secrets are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import base_name
from ..operators.nesting import enclosing, running_depth
from .text import is_secret, lines

#: Flags of a deploy command and the properties they give.
DEPLOY_FLAGS = ("region", "cpu", "memory", "concurrency", "max-instances", "min-instances", "timeout", "ingress", "service-account")
_KEYS = ["project", "rel_path"]


def is_compose(path: Column | str) -> Column:
    return F.lower(base_name(path)).rlike(r"^(docker-)?compose([.\-][\w.\-]*)?\.ya?ml$")


def is_cloudbuild(path: Column | str) -> Column:
    return F.lower(base_name(path)).rlike(r"^cloudbuild[\w.\-]*\.ya?ml$")


def is_terraform(path: Column | str) -> Column:
    return F.lower(base_name(path)).rlike(r"\.(tf|tofu)$")


def _plain(value: Column) -> Column:
    """A YAML scalar without a comment and quotes."""
    value = F.trim(value)
    quoted = F.regexp_extract(value, r"""^(?:"((?:\\.|[^"\\])*)"|'([^']*)')""", 0)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.trim(F.regexp_replace(value, r"(^|\s)#.*$", "")))


def yaml_paths(files: DataFrame) -> DataFrame:
    """(project, rel_path, line, path, key, value, raw) of YAML files (project, rel_path,
    text): for each key and list item the keys that enclose it, outermost first. A list
    item is the key `-` with its line, so that items differ; a line `- key: value` gives
    both. Flow lists stay values; lines of block scalars are rows below their key."""
    rows = lines(files.select(*_KEYS, "text")).where(~F.col("content").rlike(r"^\s*(#.*)?$") & ~F.col("content").rlike(r"^(---|\.\.\.)"))
    rows = rows.withColumn("content", F.regexp_replace(F.regexp_replace("content", "\t", "  "), r"\s+$", ""))
    indent = F.length("content") - F.length(F.ltrim("content"))
    item = F.col("content").rlike(r"^\s*-(\s|$)")
    rest = F.when(item, F.regexp_replace("content", r"^\s*-\s*", "")).otherwise(F.ltrim("content"))
    inner = F.when(item, F.length("content") - F.length(rest)).otherwise(indent)
    pattern = r"""^(?:"([^"]+)"|'([^']+)'|([^\s"'\[{#&*!|>%@`][^:]*?))\s*:(?:\s+(.*))?$"""
    key = F.concat(*(F.regexp_extract(rest, pattern, i) for i in (1, 2, 3)))
    rows = rows.select(*_KEYS, "line", indent.alias("indent"), item.alias("item"), inner.alias("inner"), rest.alias("raw"), key.alias("key"), F.regexp_extract(rest, pattern, 4).alias("after"))
    # A key may stand at the level of the list items below it: items lie half a level deeper.
    dash = rows.where("item").select(*_KEYS, (2 * F.col("line")).alias("place"), (2 * F.col("indent") + 1).alias("level"), F.concat(F.lit("-"), F.col("line").cast("string")).alias("opener"), F.lit("-").alias("key"), F.when(F.col("key") == "", _plain(F.col("raw"))).otherwise("").alias("value"), "raw")
    named = rows.where("key <> '' or not item").select(*_KEYS, (2 * F.col("line") + 1).alias("place"), (2 * F.col("inner")).alias("level"), F.nullif("key", F.lit("")).alias("opener"), "key", F.when(F.col("key") == "", F.col("raw")).otherwise(_plain(F.col("after"))).alias("value"), "raw")
    both = dash.unionByName(named)
    path = enclosing(both, _KEYS, "place", "level", "opener")
    return both.join(path, [*_KEYS, "place"]).select(*_KEYS, F.floor(F.col("place") / 2).cast("int").alias("line"), "path", "key", "value", "raw")


def flow_items(value: Column) -> Column:
    """Items of a flow list `[a, 'b', "c"]`; of other values none."""
    inside = F.regexp_extract(F.trim(value), r"^\[(.*)\]$", 1)
    found = F.regexp_extract_all(inside, F.lit(r"""\s*("(?:\\.|[^"\\])*"|'[^']*'|[^,]+)\s*(?:,|$)"""), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")), lambda x: x != "")


def compose_facts(files: DataFrame) -> DataFrame:
    """Facts of the services of compose files."""
    rows = yaml_paths(files.where(is_compose("rel_path"))).withColumn("full", F.concat("path", F.array(F.when(F.col("key") == "-", F.lit("-")).otherwise(F.col("key")))))
    rows = rows.where((F.get("full", F.lit(0)) == "services") & (F.size("full") >= 2)).withColumns({"item": F.get("full", F.lit(1)), "field": F.get("full", F.lit(2)), "depth": F.size("full"), "leaf": F.col("key")})
    name = F.get("full", F.lit(3))
    pair = F.regexp_extract("value", r"^([^=]+)=(.*)$", 1), F.regexp_extract("value", r"^([^=]+)=(.*)$", 2)
    one = lambda kind, key, value, where: F.when(where, F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))))
    each = lambda kind, where: F.when(where, F.transform(flow_items(F.col("value")), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("key"), v.alias("value"))))
    listed, nothing = (F.col("depth") == 4) & (F.col("leaf") == "-"), F.lit("")
    found = [one("service", F.col("item"), nothing, F.col("depth") == 2)]
    for field in ("image", "container_name"):
        found.append(one(field, nothing, F.col("value"), (F.col("field") == field) & (F.col("depth") == 3) & (F.col("value") != "")))
    found.append(one("build_context", nothing, F.col("value"), (F.col("field") == "build") & (F.col("value") != "") & ((F.col("depth") == 3) | ((F.col("depth") == 4) & (F.col("leaf") == "context")))))
    for field in ("ports", "expose", "volumes", "depends_on", "networks"):
        here = F.col("field") == field
        found += [one(field, nothing, F.col("value"), here & listed & (F.col("value") != "")), each(field, here & (F.col("depth") == 3))]
    for field in ("depends_on", "networks"):  # also as a map
        found.append(one(field, nothing, F.col("leaf"), (F.col("field") == field) & (F.col("depth") == 4) & ~F.startswith("leaf", F.lit("-")) & (F.col("leaf") != "")))
    here = F.col("field") == "environment"
    found += [one("environment", name, F.col("value"), here & (F.col("depth") == 4) & (F.col("leaf") != "-") & (F.col("leaf") != "")), one("environment", pair[0], pair[1], here & listed & (pair[0] != ""))]
    facts = rows.select(*_KEYS, "item", "line", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f")).select(*_KEYS, "item", "f.*", "line")
    return facts.where(~((F.col("kind") == "environment") & is_secret("key", "value")))


def cloudbuild_facts(files: DataFrame) -> DataFrame:
    """Facts of build files: substitutions, images, and the flags of the first step that
    deploys, whether its arguments are a list, a flow list or a script."""
    rows = yaml_paths(files.where(is_cloudbuild("rel_path")))
    top, depth = F.get("path", F.lit(0)), F.size("path")
    fact = lambda rows, kind, key, value: rows.select(*_KEYS, F.lit("").alias("item"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), key.alias("key"), value.alias("value"), "line")
    set_ = rows.where((top == "substitutions") & (depth == 1))
    out = fact(set_.where(~is_secret("key", "value")), "substitutions", F.col("key"), F.col("value"))
    out = out.unionByName(fact(set_.where("key = '_SERVICE_NAME'"), "service_name", F.lit(""), F.col("value")))
    image = Window.partitionBy(*_KEYS).orderBy("line")
    images = rows.where((top == "images") & (F.col("key") == "-")).unionByName(rows.where((depth == 0) & (F.col("key") == "images")).withColumn("value", F.get(flow_items(F.col("value")), F.lit(0))).where("value is not null"))
    out = out.unionByName(fact(images.withColumn("_n", F.row_number().over(image)).where("_n = 1"), "image_registry", F.lit(""), F.col("value")))
    # What a step says, as one command: list marks, quotes and line ends aside.
    words = F.regexp_replace(F.regexp_replace("raw", r"""^-\s+|\\$|^[\w\-]+:\s*[|>]?[+\-]?\s*$""", ""), r"""[\[\]"',]\s*(?=[\s\]"',]|$)|(?<=[\s\[,]|^)["'\[]""", " ")
    steps = rows.where((top == "steps") & (depth >= 2)).withColumn("step", F.get("path", F.lit(1))).dropDuplicates([*_KEYS, "line"])
    said = steps.groupBy(*_KEYS, "step").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", words.alias("words")))), lambda x: x["words"]), " ").alias("command"))  # one step's lines
    first = Window.partitionBy(*_KEYS).orderBy("line")
    deploy = said.where(F.col("command").rlike(r"\brun\s+deploy\b")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    flags = F.array_compact(F.array(*(F.when(value != "", F.struct(F.lit("deploy_" + flag.replace("-", "_")).alias("kind"), F.lit("").alias("key"), value.alias("value"))) for flag in DEPLOY_FLAGS for value in [F.regexp_extract("command", rf"--{flag}(?:=|\s+)(\S+)", 1)])))
    given = F.split(F.regexp_extract("command", r"--(?:set|update)-env-vars(?:=|\s+)(\S+)", 1), ",")
    variables = F.transform(F.filter(given, lambda v: F.contains(v, F.lit("="))), lambda v: F.struct(F.lit("deploy_env_vars").alias("kind"), F.substring_index(v, "=", 1).alias("key"), F.regexp_replace(v, "^[^=]*=", "").alias("value")))
    told = deploy.select(*_KEYS, F.lit("").alias("item"), F.explode(F.concat(flags, variables)).alias("f"), "line").select(*_KEYS, "item", "f.*", "line")
    return out.unionByName(told.where(~((F.col("kind") == "deploy_env_vars") & is_secret("key", "value"))))


def terraform_facts(files: DataFrame) -> DataFrame:
    """Facts of Terraform files: the blocks at the top, attributes of variables and modules,
    the backend. Comments are left out, and braces in strings don't count."""
    rows = lines(files.where(is_terraform("rel_path")).select(*_KEYS, "text")).withColumn("content", F.trim("content")).where(~F.col("content").rlike(r"^(#|//|$)"))
    bare = F.regexp_replace("content", r'"(?:\\.|[^"\\])*"', '""')
    bare = F.regexp_replace(bare, r"(#|//).*$", "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    head = r'^(\w+)\s*(?:"([^"]*)")?\s*(?:"([^"]*)")?\s*\{'
    rows = rows.withColumn("level", F.greatest(F.lit(0), running_depth(count("{") - count("}"), "line", *_KEYS)).cast("int"))
    opener = F.when(F.col("content").rlike(head), F.concat_ws("|", *(F.regexp_extract("content", head, i) for i in (1, 2, 3)))).when(count("{") > count("}"), F.lit("||"))
    rows = rows.withColumn("opener", opener)
    path = enclosing(rows, _KEYS, "line", "level", "opener")
    rows = rows.join(path, [*_KEYS, "line"])
    part = lambda c, i: F.get(F.split(c, r"\|"), F.lit(i))
    top = (F.col("level") == 0) & F.col("opener").isNotNull()
    kind = part(F.col("opener"), 0)
    fact = lambda rows, kind, key, value: rows.select(*_KEYS, F.lit("").alias("item"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), key.alias("key"), value.alias("value"), "line")
    first, second = part(F.col("opener"), 1), part(F.col("opener"), 2)
    out = fact(rows.where(top & kind.isin("resource", "data")), kind, first, second)
    out = out.unionByName(fact(rows.where(top & kind.isin("variable", "output", "provider", "module")), kind, first, F.lit("")))
    out = out.unionByName(fact(rows.where(top & (kind == "locals")), "locals", F.lit(""), F.lit("true")))
    # Attributes of a block, on its own lines or between the braces of its first.
    owner = F.when(top, F.col("opener")).otherwise(F.get("path", F.lit(0)))
    attribute = r'(?:^|\{|;)\s*(default|type|description|source)\s*=\s*("(?:\\.|[^"\\])*"|[^;}#]+)'
    inside = rows.where((F.col("level") == 1) | (top & (count("{") == count("}")))).withColumns({"owner": owner, "name": F.regexp_extract("content", attribute, 1), "value": F.regexp_replace(F.trim(F.regexp_extract("content", attribute, 2)), '^"(.*)"$', "$1")}).where("name <> ''")
    block, label = part(F.col("owner"), 0), part(F.col("owner"), 1)
    wanted = ((block == "variable") & F.col("name").isin("default", "type", "description")) | ((block == "module") & (F.col("name") == "source"))
    given = inside.where(wanted & ~((F.col("name") == "default") & is_secret(label, F.col("value"))))
    out = out.unionByName(fact(given, F.concat_ws("_", block, "name"), label, F.col("value")))
    backend = rows.where((F.col("level") == 1) & (kind == "backend") & (part(F.get("path", F.lit(0)), 0) == "terraform"))
    return out.unionByName(fact(backend, "backend", F.lit(""), first))


def line_facts(files: DataFrame) -> DataFrame:
    """Facts that a line alone shows, of Dockerfiles, dotenv and shell files."""
    rows = lines(files.select(*_KEYS, "text"))
    name, c = F.lower(base_name("rel_path")), F.col("content")
    docker, env, shell = name.rlike(r"^dockerfile|\.dockerfile$"), name.rlike(r"^\.env|\.env$"), name.rlike(r"\.(sh|bash|zsh)$")
    rows = rows.where(docker | env | shell)
    kinds = [
        (docker, "base_image", r"(?i)^\s*(FROM)\s+(?:--\S+\s+)*(\S+)"), (docker, "stage", r"(?i)^\s*(FROM)\s+(?:--\S+\s+)*\S+\s+AS\s+(\S+)"), (docker, "port", r"(?i)^\s*(EXPOSE)\s+(\d+)"),
        (docker, "variable", r"(?i)^\s*(?:ENV|ARG)\s+(\w+)[= ]\s*\"?([^\"\s]*)"), (docker, "entry", r"(?i)^\s*(CMD|ENTRYPOINT)\s+(.+)$"), (docker, "workdir", r"(?i)^\s*(WORKDIR)\s+(\S+)"), (docker, "user", r"(?i)^\s*(USER)\s+(\S+)"),
        (env, "variable", r"^\s*(?:export\s+)?(\w+)\s*=\s*[\"']?([^\"'#\s]*)"), (shell, "variable", r"^\s*(?:export\s+)?([A-Za-z_]\w*)=[\"']?([^\"'\s]*)"),
        (shell, "source", r"^\s*(source|\.)\s+(\S+)"), (shell, "docker", r"^\s*(docker(?:-compose)?)\s+(\w+)"), (shell, "shebang", r"^(#!)\s*(\S.*)$"),
    ]
    found = F.array_compact(F.array(*(F.when(where & c.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(c, p, 1).alias("key"), F.regexp_extract(c, p, 2).alias("value"))) for where, kind, p in kinds)))
    out = rows.select(*_KEYS, F.lit("").alias("item"), F.explode(found).alias("f"), "line").select(*_KEYS, "item", "f.*", "line")
    return out.where(~((F.col("kind") == "variable") & is_secret("key", "value")) & ~((F.col("kind") == "shebang") & (F.col("line") > 1)))


def infra_facts(files: DataFrame) -> DataFrame:
    """Facts of all infrastructure files among files (project, rel_path, text)."""
    out = line_facts(files)
    for more in (compose_facts(files), cloudbuild_facts(files), terraform_facts(files)):
        out = out.unionByName(more.withColumn("line", F.col("line").cast("int")))
    return out


def infra_nodes(facts: DataFrame) -> DataFrame:
    """InfraFile nodes, one for each file and one for each service of a compose file, with
    their facts as properties. The base image is the last stage's; all are listed too."""
    several = {"base_image": "base_images", "port": "ports", "ports": "ports", "variable": "variables", "expose": "expose", "volumes": "volumes", "depends_on": "depends_on", "networks": "networks", "resource": "resources", "data": "data_sources", "output": "outputs", "provider": "providers", "module": "modules", "stage": "stages", "source": "sources", "docker": "docker_commands"}
    keyed = {"environment": "environment", "substitutions": "substitutions", "deploy_env_vars": "deploy_env_vars", "variable_default": "variable_defaults", "variable_type": "variable_types", "module_source": "module_sources"}
    single = ["image", "container_name", "build_context", "service_name", "image_registry", "backend", "entry", "workdir", "user", "shebang", *("deploy_" + f.replace("-", "_") for f in DEPLOY_FLAGS)]
    shown = F.when(F.col("kind") == "variable", F.col("key")).when(F.col("kind").isin("resource", "data"), F.concat_ws(".", "key", "value")).when(F.col("kind").isin("output", "provider", "module"), F.col("key")).when(F.col("kind") == "docker", F.concat_ws(" ", "key", "value")).otherwise(F.col("value"))
    names = sorted(set(several.values()))
    lists = {n: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*(k for k, v in several.items() if v == n)), shown))) for n in names}
    maps = {n: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.struct("key", "value"))))) for k, n in keyed.items()}
    ones = {n: F.max_by(F.when(F.col("kind") == n, F.col("value")), F.when(F.col("kind") == n, F.col("line"))) for n in single}
    last = F.max_by(F.when(F.col("kind") == "base_image", F.col("value")), F.when(F.col("kind") == "base_image", F.col("line")))
    unique = facts.groupBy(*_KEYS, "item", "kind", "key").agg(F.max_by("value", "line").alias("value"), F.max("line").alias("line")).where("kind in ('environment', 'substitutions', 'deploy_env_vars', 'variable_default', 'variable_type', 'module_source')")
    rows = facts.where("kind not in ('environment', 'substitutions', 'deploy_env_vars', 'variable_default', 'variable_type', 'module_source')").select(*_KEYS, "item", "kind", "key", "value", "line").unionByName(unique)
    grouped = rows.groupBy(*_KEYS, "item").agg(*(v.alias(n) for n, v in lists.items()), *(v.alias(n) for n, v in maps.items()), *(v.alias(n) for n, v in ones.items()), last.alias("base_image"), F.max(F.when(F.col("kind") == "locals", F.lit(True))).alias("has_locals"))
    given = [F.when(F.size(n) > 0, F.col(n)).alias(n) for n in (*names, *maps)] + [F.col(n) for n in (*ones, "base_image", "has_locals")]
    qn = F.concat_ws(".", F.concat("project", F.lit(".__infra__")), F.translate("rel_path", "/", "."), F.nullif("item", F.lit("")))
    name = F.when(F.col("item") != "", F.col("item")).otherwise(base_name("rel_path"))
    return grouped.select(F.xxhash64("project", qn).alias("id"), "project", F.lit("InfraFile").alias("label"), name.alias("name"), qn.alias("qualified_name"), F.col("rel_path").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.to_json(F.struct(*given)).alias("properties"))
