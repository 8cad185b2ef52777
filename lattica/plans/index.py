"""From facts to a graph. Nodes and edges are first named, then told by the hash of their
names, so that all edges are checked against nodes in one join for each end.

References, whose resolution is the bulk of the work, are kept by the file they stand in: a
change resolves again the files that changed and those that mention a name whose meaning may
have changed. All else is derived anew from facts, without reading a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import is_test_path, module_qn, simple_name
from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from ..operators import community, config, derive, go_routes, http, joins
from ..operators.resolve import REGISTRY_LABELS, resolve, stub_rows, without_typed
from ..operators.upsert import last_wins
from ..sources.infra import infra_nodes
from ..sources.text import git_log
from ..storage import cutter
from .facts import KINDS, extract

REFERENCES = "rel_path string, project string, source_qn string, target_qn string, kind string, strategy string, confidence double"
#: Kinds of facts whose name is looked up among definitions.
LOOKED_UP = ("call", "base", "raise", "read", "write", "type", "assign", "typed_call", "import", "handler", "mount")


class Facts:
    """A table of facts by kind, and how many there are of each."""

    def __init__(self, table: DataFrame):
        self.table = table
        counts = {k: F.count_if(F.col("kind") == k) for k in KINDS}
        counts |= {"interface": F.count_if((F.col("kind") == "definition") & (F.col("label") == "Interface")), "test": F.count_if((F.col("kind") == "file") & is_test_path("rel_path")), "names": F.count_if((F.col("kind") == "mention") & (F.col("label") == ""))}
        self.n = table.agg(*(v.alias(k) for k, v in counts.items())).first().asDict()

    def of(self, *kinds: str) -> DataFrame:
        return self.table.where(F.col("kind").isin(*kinds))

    def references(self, kind: str) -> DataFrame:
        return self.of(kind).select("project", "rel_path", F.col("owner").alias("source_qn"), F.col("detail").alias("module_qn"), F.col("name").alias("callee"))

    def definitions(self) -> DataFrame:
        return self.of("definition").select("project", "rel_path", "name", "qualified_name", "label", "start_line", "end_line", F.col("owner").alias("parent_class"), F.col("detail").alias("docstring"), F.col("extra").alias("decorators"))

    def imports(self) -> DataFrame:
        return self.of("import").select("project", F.col("owner").alias("module_qn"), F.col("name").alias("local_name"), F.col("qualified_name").alias("module_path"))

    def known(self) -> DataFrame:
        """(project, qualified_name, name, label) of what references can mean."""
        rows = self.of("definition", "key").select("project", "qualified_name", F.when(F.col("kind") == "key", "Variable").otherwise(F.col("label")).alias("label"))
        stubs = stub_rows(self.of("typed_call").select("project", F.col("qualified_name").alias("target_qn")), rows) if self.n["typed_call"] else None
        if stubs is not None:
            rows = rows.unionByName(stubs.select("project", "qualified_name", "label"))
        return rows.where(F.col("label").isin(*REGISTRY_LABELS)).select("project", "qualified_name", simple_name("qualified_name").alias("name"), "label").distinct()


# Routes.


def _meant(refs: DataFrame, maps: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows of refs (project, module_qn, callee, ...) with the function each one names."""
    rest = [c for c in refs.columns if c not in ("module_qn", "callee")]
    rows = refs.join(maps, ["project", "module_qn"], "left").withColumn("ref_id", F.xxhash64("project", "module_qn", "callee"))
    found = resolve(rows.dropDuplicates(["ref_id"]), functions, fuzzy=False).select("ref_id", "target_qn")
    return rows.join(found, "ref_id", "left").select(*rest, "target_qn")


def _routes(facts: Facts, maps: DataFrame, known: DataFrame, cut) -> tuple[DataFrame | None, DataFrame | None]:
    """Routes (project, qualified_name, method, path, protocol) below the prefixes they are
    mounted at, and the calls that register a handler (project, source_qn, target_qn)."""
    if not facts.n["route"] + facts.n["handler"]:
        return None, None
    functions = known.where("label in ('Function', 'Method')")
    own = facts.of("route").select("project", "qualified_name", F.col("owner").alias("module_qn"), F.col("name").alias("router_variable"), F.col("label").alias("method"), F.col("detail").alias("path"), F.get("extra", F.lit(0)).alias("protocol"))
    if facts.n["mount"]:
        prefixes = facts.of("mount").where("label = 'router'").select("project", F.col("owner").alias("module_qn"), F.col("name").alias("variable"), F.col("detail").alias("prefix"))
        own = http.with_prefixes(own, http.mounted(prefixes, maps))
    own = own.select("project", "qualified_name", "method", "path", "protocol")
    registered = None
    if facts.n["handler"]:
        refs = facts.of("handler").select("project", F.get("extra", F.lit(0)).alias("module_qn"), F.col("name").alias("callee"), F.col("owner").alias("source_qn"), F.col("label").alias("method"), F.col("detail").alias("path"))
        # A call that is known to be a route gives its method; one that isn't counts where its handler is known.
        here = own.select("project", F.col("qualified_name").alias("source_qn"), "path", F.col("method").alias("_method")).distinct()
        refs = _meant(refs, maps, functions).join(here, ["project", "source_qn", "path"], "left").withColumn("method", F.when(F.col("method") != "", F.col("method")).otherwise(F.coalesce("_method", F.lit("")))).drop("_method")
        refs = cut("registrations", refs.where("target_qn is not null or method <> ''").distinct())
        registered = refs.where("target_qn is not null")
        own = own.join(registered.select("project", F.col("source_qn").alias("qualified_name"), "path").distinct(), ["project", "qualified_name", "path"], "left_anti")
        named = refs.select("project", F.coalesce("target_qn", "source_qn").alias("qualified_name"), "method", "path", F.lit("http").alias("protocol"), F.col("source_qn").alias("_by"))
        own = cut("named_routes", own.withColumn("_by", F.col("qualified_name")).unionByName(named))
        if facts.n["mount"]:
            # Functions that others hand a group to: all that they register lies below it.
            mounts = facts.of("mount").where("label = 'call'").select("project", F.get("extra", F.lit(0)).alias("module_qn"), F.col("name").alias("callee"), F.col("detail").alias("prefix"))
            below = _meant(mounts, maps, functions).where("target_qn is not null").select("project", F.col("target_qn").alias("_by"), F.col("prefix").alias("_prefix")).distinct()
            own = own.join(cut("mounts", below), ["project", "_by"], "left").withColumn("path", F.when(F.col("_prefix").isNotNull(), go_routes.joined("_prefix", "path")).otherwise(F.col("path"))).drop("_prefix")
        own = own.drop("_by")
    if facts.n["mention"]:
        # What a handler's own text shows: sockets and streams of events.
        shown = facts.of("mention").where("label = 'protocol'").groupBy("project", F.col("owner").alias("qualified_name")).agg(F.max("detail").alias("_shown"))
        own = own.join(shown, ["project", "qualified_name"], "left").withColumn("protocol", F.when((F.col("protocol") == "http") & F.col("_shown").isNotNull(), F.col("_shown")).otherwise(F.col("protocol"))).drop("_shown")
    own = own.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    return cut("routes", own.distinct()), registered


# Nodes.


def _nodes(facts: Facts, routes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the edges between files, folders and definitions (project, source_qn,
    target_qn, type)."""
    defs = facts.definitions()
    if facts.n["key"]:
        none = F.array().cast("array<string>")
        keys = facts.of("key").select("project", "rel_path", "name", "qualified_name", F.lit("Variable").alias("label"), "start_line", "end_line", F.lit("").alias("parent_class"), F.lit("").alias("docstring"), none.alias("decorators"))
        defs = defs.unionByName(keys)
    if routes is not None:
        defs = defs.join(routes.select("project", "qualified_name").distinct().withColumn("is_entry_point", F.lit(True)), ["project", "qualified_name"], "left")
    base, contains = derive.structure(facts.of("file").select("project", "rel_path"))
    own, defines = derive.definitions(defs)
    parts = [base, own]
    if facts.n["infra"]:
        parts.append(infra_nodes(facts.of("infra").select("project", "rel_path", F.col("qualified_name").alias("item"), F.col("label").alias("kind"), F.col("name").alias("key"), F.col("detail").alias("value"), F.col("start_line").alias("line"))))
    if routes is not None:
        parts.append(http.route_nodes(routes))
    if facts.n["typed_call"]:
        parts.append(stub_rows(facts.of("typed_call").select("project", F.col("qualified_name").alias("target_qn")), facts.of("definition").select("project", "qualified_name")))
    every = reduce(DataFrame.unionByName, [p.select(*NODE_SCHEMA.names) for p in parts])
    # Of several definitions of one name the one that says most, then the last line and file.
    rank = F.struct(F.length("properties"), "start_line", "file_path", "label")
    return last_wins(every.withColumn("_rank", rank), ["project", "qualified_name"], "_rank").select(*NODE_SCHEMA.names), contains.unionByName(defines)


# References.


def references(facts: Facts, every: Facts, known: DataFrame, maps: DataFrame, cut) -> DataFrame:
    """REFERENCES of the files of `facts`: calls and other mentions of names, resolved among
    all that is `known`. Returned types come from `every` file."""
    assigns = facts.of("assign").select("project", F.col("detail").alias("module_qn"), F.col("name").alias("variable"), F.col("qualified_name").alias("type_name"))
    if facts.n["assign"] and every.n["returns"]:
        returns = every.of("returns").select("project", "qualified_name", F.col("name").alias("type_name"))
        types = derive.variable_types(assigns, returns, known, maps, cut)
    else:
        types = derive.type_map(assigns, known)
    calls = facts.references("call")
    typed = derive.method_calls(calls, types, known)
    if facts.n["typed_call"]:
        told = facts.of("typed_call").select("project", "rel_path", F.col("owner").alias("source_qn"), F.col("qualified_name").alias("target_qn"), F.col("label").alias("strategy"), F.lit(0.95).alias("confidence"))
        typed = typed.unionByName(told)
    typed = cut("typed", typed.dropDuplicates(["project", "rel_path", "source_qn", "target_qn"]))
    named = known.select("project", F.col("name").alias("short"), "label")
    only = lambda rows, *labels: rows.withColumn("short", simple_name("callee")).join(named.where(F.col("label").isin(*labels)).select("project", "short").distinct(), ["project", "short"], "left_semi").drop("short")
    used = facts.references("read").join(calls.select("project", "source_qn", "callee").distinct(), ["project", "source_qn", "callee"], "left_anti")
    decorations = derive.decorations(facts.definitions().withColumn("module_qn", module_qn("project", "rel_path")))
    # Those by a short name alone only where it is a call, a base, an exception or a
    # decorator. USAGE is what isn't called.
    kinds = [
        ("call", without_typed(calls, typed), F.lit("CALLS"), True), ("base", facts.references("base"), F.lit("INHERITS"), True), ("raise", facts.references("raise"), derive.throw_kind("callee"), True),
        ("definition", decorations, F.lit("DECORATES"), True), ("read", only(used, "Function", "Method", "Class"), F.lit("USAGE"), False), ("read", only(facts.references("read"), "Variable"), F.lit("READS"), False),
        ("write", only(facts.references("write"), "Variable"), F.lit("WRITES"), False), ("type", only(facts.references("type"), "Class", "Type", "Interface", "Enum"), F.lit("USES_TYPE"), False),
    ]
    some = [rows.select("project", "rel_path", "source_qn", "module_qn", "callee", kind.alias("kind"), F.lit(loose).alias("fuzzy")) for name, rows, kind, loose in kinds if facts.n[name]]
    out = typed.select("rel_path", "project", "source_qn", "target_qn", F.lit("CALLS").alias("kind"), "strategy", "confidence")
    if some:
        names = [c.split()[0] for c in REFERENCES.split(", ")]
        out = out.unionByName(derive.resolved_references(reduce(DataFrame.unionByName, some), maps, known).select(*names))
    return out


def changed_names(old: DataFrame, new: DataFrame, every: DataFrame) -> DataFrame:
    """(project, short): simple names whose meaning may differ between the old and the new
    facts of changed files: definitions and keys that came, went or changed their label,
    functions that return something else, and those, in `every` file, that return a class
    of such a name."""
    rows = lambda facts, side: facts.where("kind in ('definition', 'key', 'returns', 'typed_call')").select("project", "kind", "qualified_name", F.when(F.col("kind") == "returns", F.col("name")).otherwise(F.col("label")).alias("says")).distinct().withColumn("side", F.lit(side))
    both = rows(old, 1).unionByName(rows(new, 2)).groupBy("project", "kind", "qualified_name", "says").agg(F.sum("side").alias("side")).where("side < 3")
    first = both.select("project", simple_name("qualified_name").alias("short")).distinct()
    returning = every.where("kind = 'returns'").select("project", simple_name("name").alias("short"), simple_name("qualified_name").alias("function"))
    return first.unionByName(returning.join(first, ["project", "short"], "left_semi").select("project", F.col("function").alias("short"))).distinct()


def affected_files(every: DataFrame, changed: DataFrame, names: DataFrame) -> DataFrame:
    """(project, rel_path): changed files and those that mention one of the names."""
    said = F.array(simple_name("name"), F.when(F.col("kind").isin("import", "assign", "typed_call"), simple_name("qualified_name")))
    rows = every.where(F.col("kind").isin(*LOOKED_UP)).select("project", "rel_path", F.explode(F.array_compact(said)).alias("short"))
    marks = every.where("kind = 'definition'").select("project", "rel_path", F.explode("extra").alias("text")).select("project", "rel_path", simple_name(derive.decorator_name("text")).alias("short"))
    hit = rows.unionByName(marks).join(names, ["project", "short"], "left_semi").select("project", "rel_path")
    return hit.unionByName(changed.select("project", "rel_path")).distinct()


# Edges.


def _linked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of named rows (project, source_qn, target_qn, type, strategy, confidence, via,
    props) whose both ends are nodes; one for each source, target and type. What several say
    of an edge is merged: the most certain way it was resolved, and how it was registered."""
    ends = {"source_id": F.xxhash64("project", "source_qn"), "target_id": F.xxhash64("project", "target_qn")}
    keyed = rows.withColumns(ends).drop("source_qn", "target_qn")
    one = keyed.groupBy("project", "source_id", "target_id", "type").agg(
        F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "strategy", "confidence")).alias("r"), F.max("via").alias("via"), F.min("props").alias("props")
    )
    told = F.to_json(F.struct(F.col("r.strategy").alias("resolution_strategy"), F.col("r.confidence").alias("confidence"), "via"))
    ids = nodes.select("id")
    one = one.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return one.select(F.xxhash64("type", "source_id", "target_id").alias("id"), "project", "source_id", "target_id", "type", F.coalesce("props", told).alias("properties"))


def _named(rows: DataFrame, kind: str | Column, **given: Column) -> DataFrame:
    empty = {"strategy": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "via": F.lit(None).cast("string"), "props": F.lit(None).cast("string")}
    return rows.select("project", "source_qn", "target_qn", (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), *((given.get(n, e)).alias(n) for n, e in empty.items()))


def derive_graph(facts: Facts, refs: DataFrame, maps: DataFrame, known: DataFrame, cut, log: DataFrame | None = None) -> Graph:
    """The graph of facts and resolved references; `log` has the lines (project, line,
    content) of `git log --name-only --pretty=format:COMMIT:%H`."""
    n = facts.n
    routes, registered = _routes(facts, maps, known, cut)
    nodes, built = _nodes(facts, routes)
    nodes = cut("nodes", nodes)
    rows = [_named(refs, F.col("kind"), strategy=F.col("strategy"), confidence=F.col("confidence")), _named(built, F.col("type"), props=F.lit("{}"))]
    if n["import"]:
        imports = derive.import_rows(facts.imports(), nodes).withColumnRenamed("module_qn", "source_qn")
        rows.append(_named(imports, "IMPORTS", props=F.to_json(F.struct(F.col("local_name").alias("alias")))))
    if routes is not None:
        handles = routes.select("project", F.col("qualified_name").alias("source_qn"), http.route_qn("project", "method", "path").alias("target_qn"))
        rows.append(_named(handles, "HANDLES", props=F.lit("{}")))
    if registered is not None:
        rows.append(_named(registered, "CALLS", via=F.lit("route_registration")))
    if n["env"]:
        reads = facts.of("env").select("project", F.col("owner").alias("source_qn"), "name")
        setters = facts.of("setter").select("project", F.col("owner").alias("setter_qn"), "name")
        variables = known.where((F.col("label") == "Variable") & derive.is_env_name("name")).select("project", F.col("qualified_name").alias("setter_qn"), "name")
        rows.append(_named(derive.env_rows(reads, setters.unionByName(variables)), "CONFIGURES", props=F.to_json(F.struct(F.col("name").alias("env_key")))))
    edges = _linked(reduce(DataFrame.unionByName, rows), nodes)
    if routes is not None and n["site"]:
        sites = facts.of("site").select(F.col("detail").alias("path"), F.col("name").alias("method"), F.col("owner").alias("source_qualified_name"), F.col("label").alias("source_label"), (F.size("extra") > 0).alias("is_async"))
        edges = edges.unionByName(http.link_edges(sites, routes, Graph(nodes, edges)))
    edges = cut("edges", edges.select(*EDGE_SCHEMA.names))
    graph, late = Graph(nodes, edges), []
    if n["interface"]:
        implements, overrides = derive.implement_edges(graph)
        late += [_linked(_named(implements, "IMPLEMENTS", props=F.lit("{}")).unionByName(_named(overrides, "OVERRIDE", props=F.lit("{}"))), nodes), derive.explicit_implement_edges(graph)]
    if n["test"]:
        tests = derive.test_file_edges(graph).withColumns({"source_qn": F.concat(module_qn("project", "source_path"), F.lit(".__file__")), "target_qn": F.concat(module_qn("project", "target_path"), F.lit(".__file__"))})
        late.append(_linked(_named(derive.test_edges(graph), "TESTS", props=F.lit("{}")).unionByName(_named(tests, "TESTS_FILE", props=F.lit("{}"))), nodes))
    if n["key"] + n["names"]:
        said = facts.of("mention").where("label = ''").select(F.xxhash64("project", "owner").alias("id"), F.col("detail").alias("value")) if n["names"] else None
        late.append(config.configure_edges(graph, said))
    if log is not None:
        late.append(joins.coupling_edges(graph, joins.change_coupling(git_log(log, "project"), limit=None)))
    parts, extra = [edges], None
    if n["call"] + n["typed_call"] + n["handler"]:
        # Communities are of who calls whom, however often and in whichever direction.
        ends = {"source_id": F.least("source_id", "target_id"), "target_id": F.greatest("source_id", "target_id")}
        calls = Graph(nodes, graph.typed("CALLS").withColumns(ends).dropDuplicates(["source_id", "target_id"]))
        members = cut("members", community.louvain(calls, ("CALLS",), None, 50, drop_singletons=True, cut=cut))
        extra, member_of = community.community_graph(graph, members)
        parts.append(member_of)
    if late:
        new = reduce(DataFrame.unionByName, [x.select(*EDGE_SCHEMA.names) for x in late])
        one = new.groupBy("id").agg(F.min(F.struct("project", "source_id", "target_id", "type", "properties")).alias("r")).select("id", "r.*")
        parts.append(one.join(edges.select("id"), "id", "left_anti"))
    out = nodes if extra is None else nodes.unionByName(extra.select(*NODE_SCHEMA.names))
    return Graph(out, reduce(DataFrame.unionByName, [x.select(*EDGE_SCHEMA.names) for x in parts]))


def graph_of_facts(table: DataFrame, cut=None, log: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph of all facts, and the references by file. `cut` writes a table and gives it back."""
    cut = cut or cutter(table.sparkSession, "index")
    facts = Facts(table)
    maps, known = cut("maps", derive.import_maps(facts.imports())), cut("known", facts.known())
    refs = cut("references", references(facts, facts, known, maps, cut))
    return derive_graph(facts, refs, maps, known, cut, log), refs


def index(files: DataFrame, cut=None, log: DataFrame | None = None) -> Graph:
    """The graph of files (project, rel_path, text)."""
    cut = cut or cutter(files.sparkSession, "index")
    return graph_of_facts(cut("facts", extract(files, cut)), cut, log)[0]
