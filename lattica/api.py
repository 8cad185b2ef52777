"""The endpoints: fourteen functions over a graph store in one folder.

Results are DataFrames, or dicts of them; `as_json` gives text. Row limits apply
here, at the edge, and nowhere before.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .functions import adr
from .functions.names import project_name
from .model import FILE_HASH_SCHEMA, NODE_SCHEMA, PROJECT_SCHEMA, SUMMARY_SCHEMA, EDGE_SCHEMA, Graph, schema_of
from .operators import architecture as A, code_search, community, derive, incremental, joins, search as S, traverse
from .plans.builder import compile_query
from .plans import facts as facts_table, index as plan
from .sources import files as files_source, otlp, text
from .storage import Cuts
from .store import BUCKETS, Store, Version

MAX_ROWS = 200
HARD_ROWS = 10_000
ASPECTS = ("languages", "packages", "entry_points", "routes", "hotspots", "boundaries", "services", "layers", "clusters", "file_tree")


def as_json(df: DataFrame, most: int = HARD_ROWS) -> str:
    """Rows of a result as a JSON array; at most `most` of them."""
    return "[" + ",".join(r[0] for r in df.limit(most).select(F.to_json(F.struct(*df.columns))).collect()) + "]"


REFERENCE_SCHEMA = schema_of(plan.REFERENCES)
#: Bytes of files that the fast mode leaves out.
FAST_BYTES = 512_000


class Engine:
    """Graphs of projects, kept in a store below `root`. Each method reads one version of
    the store, and what it writes becomes one new version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)
        #: What the last index did: files read, files whose references were resolved.
        self.work: dict[str, int] = {}

    def _rows(self, version: Version, name: str, schema: StructType, project: str | None = None) -> DataFrame:
        return self.store.table(version, name, schema, project)

    def _graph(self, version: Version, project: str | None = None) -> Graph:
        return Graph(self._rows(version, "nodes", NODE_SCHEMA, project), self._rows(version, "edges", EDGE_SCHEMA, project), closed=True)

    @property
    def graph(self) -> Graph:
        return self._graph(self.store.read())

    def _of(self, project: str | None) -> Graph:
        return self._graph(self.store.read(), project)

    # Indexing and projects.

    def index_repository(self, path: str, project: str | None = None, log: str | None = None, mode: str = "full") -> dict[str, int]:
        """Index a folder of files: how many are new, changed, unchanged and removed. Files
        of the size and time that the store has aren't read; of a changed file only its own
        facts are made anew, and only references that it may concern are resolved again. The
        graph is that of a whole index. `log` is the text of `git log --name-only
        --pretty=format:COMMIT:%H`; without it files that change together aren't linked. The
        mode `fast` leaves out files of more than FAST_BYTES."""
        if mode not in ("full", "fast"):
            raise ValueError(f"no such mode: {mode}")
        project = project or project_name(path)
        version, cuts = self.store.read(), Cuts(self.spark, "index")
        stored = self._rows(version, "file_hashes", FILE_HASH_SCHEMA, project)
        listed = files_source.list_files(self.spark, path, FAST_BYTES if mode == "fast" else None)
        same = ["rel_path", "size", "mtime_ns"]
        fresh = cuts.cut(files_source.read_texts(path, listed.join(stored.select(*same), same, "left_anti"))).withColumn("project", F.lit(project))
        kept = stored.join(listed.select(*same), same, "left_semi")
        current = cuts.cut(fresh.select(*FILE_HASH_SCHEMA.names).unionByName(kept.select(*FILE_HASH_SCHEMA.names)))
        changes = cuts.cut(incremental.classify(current, stored))
        counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
        self.work = {"read": fresh.count(), "resolved": 0}
        if set(counts) - {"unchanged"}:
            changed = changes.where("status in ('new', 'changed')").select("project", "rel_path")
            texts = fresh.join(changed, ["project", "rel_path"], "left_semi")
            history = None if log is None else text.numbered(self.spark, log).withColumn("project", F.lit(project))
            new = cuts.cut(facts_table.extract(texts, lambda _, df: cuts.cut(df)))
            self._derive(version, cuts, project, new, changes, path, history, current)
        return counts

    def index_facts(self, facts: DataFrame, project: str, log: str | None = None) -> None:
        """Index facts of any extractor (see plans/facts.py) in place of a project's old
        ones. Facts are checked first; those of other projects are an error."""
        cuts, version = Cuts(self.spark, "index"), self.store.read()
        facts = cuts.cut(facts_table.checked(facts))
        if facts.where(F.col("project") != project).first():
            raise ValueError(f"facts of other projects than {project}")
        new = cuts.cut(facts_table.with_code(facts, lambda _, df: cuts.cut(df)))
        gone = self._rows(version, "facts", facts_table.FACT_SCHEMA, project).where("kind = 'file'").select("project", "rel_path")
        here = new.where("kind = 'file'").select("project", "rel_path").distinct()
        changes = gone.join(here, ["project", "rel_path"], "left_anti").withColumn("status", F.lit("removed")).unionByName(here.withColumn("status", F.lit("changed")))
        history = None if log is None else text.numbered(self.spark, log).withColumn("project", F.lit(project))
        self._derive(version, cuts, project, new, cuts.cut(changes), "", history, None)

    def _derive(self, version: Version, cuts: Cuts, project: str, new: DataFrame, changes: DataFrame, path: str, history: DataFrame | None, hashes: DataFrame | None) -> None:
        """The project's graph from the facts of changed files (`new`) and the stored facts of
        all others, as one new version."""
        cut, key = (lambda _, df: cuts.cut(df)), ["project", "rel_path"]
        touched = changes.where("status <> 'unchanged'").select(*key)
        old = self._rows(version, "facts", facts_table.FACT_SCHEMA, project)
        whole = not version.folders("facts", project)
        if whole:
            graph, refs = plan.graph_of_facts(new, cut, history)
            self.work["resolved"] = new.where("kind = 'file'").count()
            writes = {("facts", project): self.store.write(new, "facts", "rel_path"), ("references", project): self.store.write(refs, "references", "rel_path")}
        else:
            every = cuts.cut(old.join(touched, key, "left_anti").unionByName(new))
            names = plan.changed_names(old.join(touched, key, "left_semi"), new, every)
            affected = cuts.cut(plan.affected_files(every, changes.where("status in ('new', 'changed')"), names))
            facts = plan.Facts(every)
            maps, known = cuts.cut(derive.import_maps(facts.imports())), cuts.cut(facts.known())
            again = plan.Facts(cuts.cut(every.join(affected, key, "left_semi")))
            resolved = cuts.cut(plan.references(again, facts, known, maps, cut))
            outdated = affected.unionByName(touched).distinct()
            stored = self._rows(version, "references", REFERENCE_SCHEMA, project)
            refs = stored.join(outdated, key, "left_anti").unionByName(resolved)
            graph = plan.derive_graph(facts, refs, maps, known, cut, history)
            self.work["resolved"] = affected.count()
            writes = {("facts", project): self._buckets(version, "facts", project, every, touched), ("references", project): self._buckets(version, "references", project, refs, outdated)}
        writes["nodes", project], writes["edges", project] = self.store.write(graph.nodes, "nodes"), self.store.write(graph.edges, "edges")
        if hashes is not None:
            writes["file_hashes", project] = self.store.write(hashes, "file_hashes")
        now = self.spark.createDataFrame([(project, datetime.now(timezone.utc).isoformat(), path)], PROJECT_SCHEMA)
        writes["projects", project] = self.store.write(now.coalesce(1), "projects")
        self.store.commit(version, writes)

    def _buckets(self, version: Version, name: str, project: str, rows: DataFrame, files: DataFrame) -> dict[str, str]:
        """Folders by bucket: those that hold any of `files` written whole, the others as they are."""
        bucket = F.pmod(F.xxhash64("rel_path"), F.lit(BUCKETS)).cast("int")
        hit = [r["b"] for r in files.select(bucket.alias("b")).distinct().collect()]  # BUCKETS at most
        held = {b: p for (_, b), p in version.folders(name, project).items() if int(b) not in hit}
        return held | (self.store.write(rows.where(bucket.isin(*hit)), name, "rel_path") if hit else {})

    def list_projects(self) -> DataFrame:
        version = self.store.read()
        graph = self._graph(version)
        nodes, edges = (d.groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias(n)) for d, n in ((graph.nodes, "nodes"), (graph.edges, "edges")))
        return self._rows(version, "projects", PROJECT_SCHEMA).join(nodes, "name", "left").join(edges, "name", "left").orderBy("name")

    def delete_project(self, project: str) -> None:
        """All tables of a project go in one version; no other project is written."""
        version = self.store.read()
        self.store.commit(version, {(table, project): {} for table, held in version.parts.items() if project in held})

    def index_status(self, project: str) -> DataFrame:
        """One row: node and edge counts and the share of calls that types resolved."""
        graph = self._of(project)
        calls = A.calls_by_strategy(graph).where("strategy in ('type_dispatch') or strategy like 'lsp_%'").agg(F.coalesce(F.sum("percent"), F.lit(0.0)).alias("typed_percent"))
        n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
        e = graph.edges.agg(F.count(F.lit(1)).alias("edges"))
        return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(calls))  # one row each

    # Queries.

    def query_graph(self, query: str, project: str | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
        return compile_query(self._of(project), query, min(max_rows or MAX_ROWS, HARD_ROWS))

    def search_graph(self, project: str | None = None, offset: int = 0, limit: int = 10, sort_by: str = "relevance", include_connected: bool = False, **filters) -> DataFrame:
        graph = self._of(project)
        rows = S.search(graph, **filters)
        by_degree = (F.col("in_degree") + F.col("out_degree")).desc()
        order = {"relevance": S.relevance(filters.get("name_pattern")), "name": [F.col("name"), F.col("qualified_name")], "degree": [by_degree, F.col("qualified_name")]}[sort_by]
        out = S.page(rows, order, offset, limit).withColumn("has_more", F.col("total") > offset + limit)
        return out.join(S.connected_names(graph, out), "id", "left") if include_connected else out

    def trace_call_path(self, name: str, project: str | None = None, direction: str = "both", depth: int = 3, min_confidence: float = 0.0) -> dict[str, DataFrame]:
        """nodes and edges around a function; where none has this exact name,
        suggestions of at most five."""
        graph = self._of(project)
        starts = graph.nodes.where(F.col("name") == name).orderBy("qualified_name", "id").limit(1).select("id")
        if starts.isEmpty():
            return {"suggestions": code_search.find_symbol(graph, name).select("qualified_name").limit(5)}
        types = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")
        edges = None
        for side, way in (("outbound", "out"), ("inbound", "in")):
            if direction in ("both", side):
                more = traverse.bfs_edges(graph, starts, types, way, max(1, min(5, depth)))
                edges = more if edges is None else edges.union(more)
        return {"nodes": traverse.trace(graph, starts, direction, depth, types), "edges": traverse.confident(edges.distinct(), min_confidence)}

    def detect_changes(self, name_status: str, diff: str, project: str | None = None, depth: int = 3) -> dict[str, DataFrame]:
        """changed files, changed symbols, impacted nodes and a summary, from the output of
        git diff --name-status and git diff --unified=0."""
        graph = self._of(project)
        files = text.git_names(text.numbered(self.spark, name_status))
        hunks = text.git_hunks(text.numbered(self.spark, diff))
        symbols = joins.changed_symbols(graph.nodes, hunks, files.where("status <> 'D'").select("path"))
        impacted = traverse.impact(graph, symbols.select("id"), depth)
        return {"files": files, "symbols": symbols, "impacted": impacted.orderBy("hop", "name"), "summary": traverse.impact_summary(impacted, graph.edges)}

    def get_architecture(self, project: str | None = None, aspects: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        graph = self._of(project)
        wanted = set(ASPECTS if not aspects or "all" in aspects else aspects)
        if wanted - set(ASPECTS):
            raise ValueError(f"no such aspect: {', '.join(sorted(wanted - set(ASPECTS)))}")
        build = {
            "languages": lambda: A.languages(graph), "packages": lambda: A.packages(graph), "entry_points": lambda: A.entry_points(graph), "routes": lambda: A.routes(graph), "hotspots": lambda: A.hotspots(graph),
            "boundaries": lambda: A.boundaries(graph), "services": lambda: A.services(graph), "layers": lambda: A.layers(graph),
            "clusters": lambda: community.cluster_summary(graph, community.louvain(graph)), "file_tree": lambda: A.file_tree(graph),
        }
        return {a: build[a]() for a in ASPECTS if a in wanted}

    def get_graph_schema(self, project: str | None = None) -> dict[str, DataFrame]:
        graph = self._of(project)
        names = lambda label: graph.labelled(label).select("name").orderBy("name")
        return {"labels": A.label_counts(graph), "types": A.type_counts(graph), "patterns": A.patterns(graph), "functions": names("Function").limit(30), "classes": names("Class").limit(20), "qualified_names": graph.nodes.select("qualified_name").orderBy("qualified_name").limit(5)}

    def get_code_snippet(self, name: str, files: DataFrame, project: str | None = None) -> dict[str, DataFrame]:
        """The code of a symbol and names of its callers and callees; candidates where a
        name stands for more than two. `files` has file and text."""
        graph = self._of(project)
        found = code_search.find_symbol(graph, name)
        some = found.limit(3).collect()
        if not some or len(some) > 2 or some[0]["tier"] == 4:
            return {"candidates": found.select("qualified_name", "label", "file_path").limit(10)}
        node = some[0]["id"]
        one = found.where(F.col("id") == node)
        return {"node": one, "code": code_search.snippets(one.select("id", "file_path", "start_line", "end_line"), files), "callers": S.neighbour_names(graph, node, "inbound"), "callees": S.neighbour_names(graph, node, "outbound")}

    def search_code(self, files: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, file_pattern: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        return code_search.page(code_search.search_code(files, pattern, regex, case_sensitive, file_pattern), offset, limit)

    def manage_adr(self, mode: str, project: str, content: str = "", sections: dict[str, str] | None = None) -> str | None:
        """get, store (a whole text), update (some sections) or delete."""
        version = self.store.read()
        row = self._rows(version, "summaries", SUMMARY_SCHEMA, project).first()
        if mode == "get":
            return row["summary"] if row else None
        if mode not in ("store", "update", "delete"):
            raise ValueError(f"no such mode: {mode}")
        if mode == "delete":
            self.store.commit(version, {("summaries", project): {}})
            return None
        if mode == "update" and row is None:
            raise ValueError("there is no text to update")
        new = content if mode == "store" else adr.merge(row["summary"], sections or {})
        if wrong := adr.validate(new):
            raise ValueError("; ".join(wrong))
        now = datetime.now(timezone.utc).isoformat()
        rows = self.spark.createDataFrame([(project, new, row["created_at"] if row else now, now)], SUMMARY_SCHEMA)
        self.store.commit(version, {("summaries", project): self.store.write(rows.coalesce(1), "summaries")})
        return new

    def ingest_traces(self, path: str, project: str) -> dict[str, int]:
        """Confirm HTTP edges by the spans of an export."""
        version, spans = self.store.read(), otlp.read_spans(self.spark, path)
        edges = self._rows(version, "edges", EDGE_SCHEMA, project)
        confirmed = Cuts(self.spark, "traces").cut(otlp.enrich(edges, otlp.span_stats(spans)))
        rows = edges.join(confirmed.select("id"), "id", "left_anti").select(*EDGE_SCHEMA.names).unionByName(confirmed.select(*EDGE_SCHEMA.names))
        self.store.commit(version, {("edges", project): self.store.write(rows, "edges")})
        return {"processed": spans.count(), "validated": confirmed.count()}
