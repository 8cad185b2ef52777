"""Routes, HTTP call sites, and the scored join between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import any_of, confidence_band
from ..model import Graph
from .joins import in_blocks

#: Words that show an HTTP client, a queue, and a protocol of a handler.
CLIENT_WORDS = (
    "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "httpx.", "aiohttp.", "urllib.request",
    "http.Get", "http.Post", "http.NewRequest", "client.Do(",
    "fetch(", "axios.", ".ajax(",
    "HttpClient", "RestTemplate", "WebClient", "OkHttpClient", "HttpURLConnection", "openConnection(",
    "reqwest::", "hyper::", "surf::", "ureq::",
    "curl_exec", "curl_init", "Guzzle", "Http::get", "Http::post",
    "sttp.", "http4s", "wsClient",
    "curl_easy", "cpr::Get", "cpr::Post", "httplib::",
    "socket.http", "http.request", "curl.",
    "RestClient", "HttpWebRequest",
    "ktor.client",
    "send_request", "http_client",
)
ASYNC_WORDS = ("CreateTask", "create_task", "topic.Publish", "publisher.publish", "topic.publish", "sqs.send_message", "sns.publish", "basic_publish", "producer.send", "producer.Send")
SOCKET_WORDS = ("websocket.Upgrade", "websocket.Accept", "upgrader.Upgrade", 'ws.on("connection', 'io.on("connection', "new WebSocket(", "WebSocketSession", "wsHandler")
EVENT_WORDS = ("text/event-stream", "EventSourceResponse", "SseEmitter", "ServerSentEvent", "event-stream")
#: Domains whose URLs are not calls between services, and paths left out.
EXTERNAL_DOMAINS = ("googleapis.com", "google.com", "github.com", "gitlab.com", "docker.com", "docker.io", "npmjs.org", "pypi.org", "cloudflare.com", "sentry.io", "aws.amazon.com")
EXCLUDED_PATHS = ("/health", "/healthz", "/ready", "/readyz", "/metrics", "/favicon.ico")
LEAST_SCORE = 0.25
_VERBS = "get|post|put|delete|patch|head|options"

_QUOTED = r"""(?:[rbfu]{0,2})(["'`])((?:(?!\%d)[^\n])*)\%d"""


def _quoted(group: int) -> str:
    """A string literal whose quote is this group; the next one is what stands in it."""
    return _QUOTED % (group, group)


#: Routes by language: (pattern, groups of the receiver, the method and the path; 0 for none).
#: A path may be empty, arguments may be named, and a call may go over lines.
ROUTES = {
    "python": [(rf"@\s*([\w.]+)\.({_VERBS}|route|api_route|websocket)\(\s*(?:(?:path|rule)\s*=\s*)?" + _quoted(3), 1, 2, 4)],
    "go": [(r"(\w+)\.((?i:get|post|put|delete|patch|head|options)|HandleFunc|Handle|Any)\(\s*" + _quoted(3) + r"\s*,", 1, 2, 4)],
    "javascript": [(rf"\b(app|router|server|api|route|routes|koa|fastify)\.({_VERBS}|all)\(\s*" + _quoted(3) + r"\s*,", 1, 2, 4)],
    "java": [(r"@(Get|Post|Put|Delete|Patch|Request|Message)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*" + _quoted(2), 0, 1, 3)],
    "rust": [(rf"#\[\s*({_VERBS})\(\s*" + _quoted(2), 0, 1, 3)],
    "php": [(rf"\bRoute::({_VERBS}|any)\(\s*" + _quoted(2), 0, 1, 3)],
    "csharp": [(r"\[\s*(HttpGet|HttpPost|HttpPut|HttpDelete|HttpPatch|Route)\(\s*" + _quoted(2), 0, 1, 3)],
    "kotlin": [(rf"(?<![\w.])({_VERBS}|webSocket)\(\s*" + _quoted(2) + r"\s*\)\s*\{", 0, 1, 3)],
}
#: Words that stand for any method, and those for sockets.
_ANY_METHOD = ("ROUTE", "API_ROUTE", "HANDLE", "HANDLEFUNC", "ANY", "ALL", "REQUEST")
_SOCKET_METHOD = ("WEBSOCKET", "MESSAGE")


def _found(text: Column, pattern: str, receiver: int, method: int, path: int) -> Column:
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = lambda x, n: F.regexp_extract(x, pattern, n) if n else F.lit("")
    return F.transform(every, lambda x: F.struct(part(x, receiver).alias("router"), F.regexp_replace(F.upper(part(x, method)), "^HTTP", "").alias("method"), part(x, path).alias("path")))


def extract_routes(sources: DataFrame) -> DataFrame:
    """Routes in texts (qualified_name, language, text; decorators and bodies alike): the
    other columns, method (upper case, WS for sockets, empty for any), path, router (the
    variable before the method, where there is one) and protocol. An empty path stays
    empty; others begin with a slash."""
    found = F.array().cast("array<struct<router:string,method:string,path:string>>")
    for language, patterns in ROUTES.items():
        found = F.when(F.col("language") == language, F.concat(*(_found(F.col("text"), *p) for p in patterns))).otherwise(found)
    rest = [c for c in sources.columns if c not in ("language", "text")]
    rows = sources.where(F.col("language").isin(*ROUTES)).select(*rest, F.explode(found).alias("r"))
    socket = F.col("r.method").isin(*_SOCKET_METHOD)
    method = F.when(socket, "WS").when(F.col("r.method").isin(*_ANY_METHOD), "").otherwise(F.col("r.method"))
    path = F.when((F.col("r.path") == "") | F.startswith(F.col("r.path"), F.lit("/")), F.col("r.path")).otherwise(F.concat(F.lit("/"), F.col("r.path")))
    return rows.select(*rest, method.alias("method"), path.alias("path"), F.col("r.router").alias("router"), F.when(socket, "ws").otherwise("http").alias("protocol")).distinct()


def handler_refs(sources: DataFrame) -> DataFrame:
    """The other columns of texts (text), path and handler: the last argument of a route
    call, for frameworks that name it."""
    call = r"\(\s*[\"'`](/[^\"'`]*)[\"'`]\s*,\s*(?:[^()\n]*,\s*)?([A-Za-z_][\w.]*)\s*\)"
    pairs = F.zip_with(F.regexp_extract_all("text", F.lit(call), F.lit(1)), F.regexp_extract_all("text", F.lit(call), F.lit(2)), lambda p, h: F.struct(p.alias("path"), h.alias("handler")))
    rest = [c for c in sources.columns if c != "text"]
    return sources.select(*rest, F.explode(pairs).alias("p")).select(*rest, "p.path", "p.handler").distinct()


#: Where a router gets a prefix: (pattern, group of the variable, of the prefix).
MOUNTS = [
    (r"(\w+)\s*:?=\s*\w+\.Group\(\s*" + _quoted(2), 1, 3),
    (r"include_router\(\s*([\w.]+)\s*,(?:[^()]|\([^()]*\))*?\bprefix\s*=\s*" + _quoted(2), 1, 3),
    (r"\.use\(\s*" + _quoted(1) + r"\s*,\s*(?:[^()\n]*,\s*)?(\w+)\s*\)", 3, 2),
]


def _mount(pattern: str, variable: int, prefix: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.regexp_extract(x, pattern, variable).alias("variable"), F.regexp_extract(x, pattern, prefix).alias("prefix"))


def group_prefixes(sources: DataFrame) -> DataFrame:
    """The other columns of texts (qualified_name, text, perhaps language), variable and
    prefix: groups and mounted routers."""
    rest = [c for c in sources.columns if c not in ("language", "text")]
    found = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _mount(p, v, q)) for p, v, q in MOUNTS]
    return sources.select(*rest, F.explode(F.concat(*found)).alias("p")).select(*rest, "p.variable", "p.prefix").distinct()


def mounted(prefixes: DataFrame, maps: DataFrame) -> DataFrame:
    """(project, router, prefix): what the variables of (project, module_qn, variable,
    prefix) mean: what a module imports under this name, else its own."""
    rows = prefixes.join(maps, ["project", "module_qn"], "left")
    own = F.concat_ws(".", "module_qn", "variable")
    return rows.groupBy("project", F.coalesce(F.try_element_at("imports", F.col("variable")), own).alias("router")).agg(F.min("prefix").alias("prefix"))


def with_prefixes(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Routes (project, module_qn, router_variable, path, ...) with the prefix under which
    their router, or else their whole module, is mounted (project, router, prefix)."""
    mine = lambda c, name: mounts.select("project", F.col("router").alias(c), F.col("prefix").alias(name))
    rows = routes.withColumn("router", F.concat_ws(".", "module_qn", "router_variable"))
    rows = rows.join(mine("router", "_own"), ["project", "router"], "left").join(mine("module_qn", "_all"), ["project", "module_qn"], "left")
    prefix = F.coalesce(F.rtrim(F.coalesce("_own", "_all"), F.lit("/")), F.lit(""))
    full = F.concat(prefix, "path")
    return rows.withColumn("path", F.when(full == "", "/").otherwise(full)).drop("_own", "_all", "router")


def route_qn(project: Column | str, method: Column | str, path: Column | str) -> Column:
    method = F.col(method) if isinstance(method, str) else method
    return F.concat(project, F.lit(".__route__."), F.when(method == "", "ANY").otherwise(method), F.lit("."), path)


def route_nodes(routes: DataFrame) -> DataFrame:
    """Route nodes of (project, method, path, protocol)."""
    method, qn = F.when(F.col("method") == "", "ANY").otherwise(F.col("method")), route_qn("project", "method", "path")
    rows = routes.groupBy("project", "method", "path").agg(F.min("protocol").alias("protocol"))
    return rows.select(F.xxhash64("project", qn).alias("id"), "project", F.lit("Route").alias("label"), F.concat_ws(" ", method, "path").alias("name"), qn.alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.to_json(F.struct("method", "path", "protocol")).alias("properties"))


def urls_in(text: Column | str) -> Column:
    """Distinct URL paths of a text: of URLs of other than external domains, and quoted
    absolute paths."""
    text = F.col(text) if isinstance(text, str) else text
    full = F.regexp_extract_all(text, F.lit(r"https?://[A-Za-z0-9_.:\-]+(?:/[A-Za-z0-9_./{}:\-]*)?"), F.lit(0))
    host = lambda u: F.regexp_extract(u, r"https?://([^/:]+)", 1)
    inner = F.filter(full, lambda u: ~any_of([(host(u) == d) | F.endswith(host(u), F.lit("." + d)) for d in EXTERNAL_DOMAINS]))
    paths = F.transform(inner, lambda u: F.regexp_extract(u, r"https?://[^/]+(/.*)?$", 1))
    quoted = F.regexp_extract_all(text, F.lit(r"[\"'`](/[A-Za-z][A-Za-z0-9_./{}:\-]*)[\"'`]"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(paths, quoted), lambda p: p.rlike(r"^/[^/]")))


def call_sites(sources: DataFrame) -> DataFrame:
    """HTTP call sites in texts (qualified_name, label, text): the other columns, path,
    method, source and whether they go through a queue. Functions need a client's or a queue's word;
    modules give their constants."""
    sync, queue = (any_of([F.contains("text", F.lit(w)) for w in words]) for words in (CLIENT_WORDS, ASYNC_WORDS))
    rows = sources.withColumns({"sync": sync, "queue": queue}).where((F.col("label") == "Module") | F.col("sync") | F.col("queue"))
    method = F.upper(F.regexp_extract("text", rf"(?i)(?:requests|httpx|axios|client|http)\.({_VERBS})\(|method\s*[:=]\s*[\"'](\w+)", 1))
    rest = [c for c in sources.columns if c not in ("qualified_name", "label", "text")]
    return rows.select(*rest, F.explode(urls_in("text")).alias("path"), method.alias("method"), F.col("qualified_name").alias("source_qualified_name"), F.col("label").alias("source_label"), (F.col("queue") & ~F.col("sync")).alias("is_async"))


def normal_path(path: Column | str) -> Column:
    """Lower case, without a last slash, parameters and ids as *."""
    path = F.col(path) if isinstance(path, str) else path
    p = F.regexp_replace(path, "/+$", "")
    p = F.regexp_replace(F.regexp_replace(p, r":[A-Za-z_]\w*", "*"), r"\{[^}]*\}", "*")
    p = F.regexp_replace(p, r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(/|$)", "/*$1")
    return F.lower(F.regexp_replace(p, r"/\d+(/|$)", "/*$1"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_score(call: Column, route: Column) -> Column:
    """How well a normalised call path fits a normalised route, 0 to 1: a base by kind
    of match, 0.95 equal, 0.75 the route ends the call, 0.55 segment by segment with
    wildcards, times the mean of the segments' Jaccard and of depth up to three."""
    parts = lambda p: F.split(p, "/")
    fits = (F.size(parts(call)) == F.size(parts(route))) & F.forall(F.zip_with(parts(call), parts(route), lambda a, b: (a == b) | (a == "*") | (b == "*")), lambda x: F.coalesce(x, F.lit(False)))
    kind = F.when((call == "") | (route == ""), 0.0).when(call == route, 0.95).when(call.endswith(route), 0.75).when(fits, 0.55).otherwise(0.0)
    left = F.when((call != route) & call.endswith(route), _segments(route)).otherwise(_segments(call))
    known = lambda s: F.array_distinct(F.filter(s, lambda x: x != "*"))
    a, b = known(left), known(_segments(route))
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))
    return F.least(F.lit(1.0), kind * (0.5 * jaccard + 0.5 * F.least(F.lit(1.0), F.size(_segments(route)) / 3.0)))


def _fitting(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call, route, base): different normalised paths that fit, and how well.

    No pair is tried that can't match: equal and wildcard matches have the same number
    of segments and agree on the first and the last of them, or one has * there; a
    route that ends a call is what follows one of the call's slashes, or, where it
    doesn't begin with a slash itself, ends a segment and has the same rest after it.
    Each is an equi-key.
    """
    parts = lambda c: F.split(c, "/")
    # Whoever has a name meets it and *; whoever has * meets all, marked as such.
    ends = lambda c: (F.coalesce(F.get(parts(c), 1), F.lit("")), F.get(parts(c), F.size(parts(c)) - 1))
    join = lambda c, head, tail: F.concat_ws("|", F.lit("n"), F.size(parts(c)).cast("string"), head, tail)
    seen = lambda x: F.when(x == "*", F.array(F.lit("~"))).otherwise(F.array(x, F.lit("*")))
    held = lambda x: F.when(x == "*", F.array(F.lit("*"), F.lit("~"))).otherwise(F.array(x, F.lit("~")))
    pairs = lambda c, side: F.flatten(F.transform(side(ends(c)[0]), lambda h: F.transform(side(ends(c)[1]), lambda t: join(c, h, t))))
    after = lambda c: F.transform(F.sequence(F.lit(2), F.size(parts(c))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/")))
    tails = F.when(F.size(parts("call")) > 1, after("call")).otherwise(F.array().cast("array<string>"))
    last = F.substring_index("call", "/", -1)
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(last))), lambda i: F.substring(last, i, F.length(last)))
    keys = F.concat(pairs("call", seen), F.transform(tails, lambda t: F.concat(F.lit("s|"), t)), F.transform(letters, lambda t: F.concat(F.lit("e|"), t)))
    slash = F.locate("/", F.col("route"))
    rest = F.when(slash == 0, "").otherwise(F.substring("route", slash, F.length("route")))
    end = F.when(rest == "", F.concat(F.lit("e|"), "route")).otherwise(F.concat(F.lit("s|"), rest))
    c = calls.withColumn("key", F.explode(F.array_distinct(keys)))
    r = routes.withColumn("key", F.explode(F.array_distinct(F.concat(pairs("route", held), F.array(end)))))
    met = c.join(r, "key").select("call", "route").distinct()
    return met.withColumn("base", path_score(F.col("call"), F.col("route"))).where("base > 0")


def _sides(sites: DataFrame, routes: DataFrame, excluded: tuple[str, ...], least: float, digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different sites and routes with their folders and classes (_call, _route), and which
    classes match: confidence, as shown (rounded to so many digits) and band. A class is all
    that a score depends on, so that it is reckoned once for two classes, not for each pair."""
    weight = F.when(F.col("source_label").isin("Function", "Method"), 1.0).otherwise(0.85)
    verb, kind = (lambda c: F.coalesce(c, F.lit(""))), (lambda *c: F.concat_ws(" ", F.length("_verb"), "_verb", *c))
    s = sites.withColumn("call", normal_path("path")).select(F.col("path").alias("url_path"), "call", F.upper("method").alias("call_method"), "source_qualified_name", "source_label", "is_async").where("call <> ''").distinct()
    s = s.withColumns({"_verb": verb("call_method"), "_weight": weight}).withColumn("_call", kind("_weight", "call"))
    low = [p.rstrip("/") for p in excluded]
    r = routes.withColumn("route", normal_path("path")).select(F.col("path").alias("route_path"), "route", F.upper("method").alias("route_method"), F.col("qualified_name").alias("route_qn")).where("route <> ''").where(~F.lower(F.regexp_replace("route_path", "/+$", "")).isin(*low)).distinct()
    r = r.withColumn("_verb", verb("route_method")).withColumn("_route", kind("route"))
    calls, served = s.select("call", "_call", "_verb", "_weight").distinct(), r.select("route", "_route", F.col("_verb").alias("_served")).distinct()
    fitting = _fitting(calls.select("call").distinct(), served.select("route").distinct())
    bonus = F.when((F.col("_verb") == "") | (F.col("_served") == ""), 0.0).when(F.col("_verb") == F.col("_served"), 0.10).otherwise(-0.15)
    scored = fitting.join(calls, "call").join(served, "route").withColumn("confidence", F.least(F.lit(1.0), F.col("base") * F.col("_weight") + bonus)).where(F.col("confidence") >= least)
    shown = F.col("confidence") if digits is None else F.round("confidence", digits)
    classes = scored.select("_call", "_route", "confidence", shown.alias("shown"), confidence_band(F.col("confidence")).alias("band"))
    s = s.withColumn("_from", _folder(F.col("source_qualified_name"))).drop("call", "_verb", "_weight")
    return s, r.withColumn("_to", _folder(F.col("route_qn"))).drop("route", "_verb"), classes


def _pairs(sites: DataFrame, routes: DataFrame, classes: DataFrame) -> DataFrame:
    """Sites and routes of matching classes and of different services, with their type."""
    met = in_blocks(sites, routes, classes, "_call", "_route").where(~((F.col("_from") != "") & (F.col("_from") == F.col("_to"))))
    return met.withColumn("type", F.when(F.col("is_async"), "ASYNC_CALLS").otherwise("HTTP_CALLS"))


def match(sites: DataFrame, routes: DataFrame, least: float = LEAST_SCORE, excluded: tuple[str, ...] = EXCLUDED_PATHS, digits: int | None = None) -> DataFrame:
    """Call sites (path, method, source_qualified_name, source_label, is_async) joined to
    routes (path, method, qualified_name) of other services with confidence (rounded to so
    many digits, if told) and band; routes of excluded paths don't match.

    Paths are scored once for each two different ones, whoever calls or serves them.
    """
    out = _pairs(*_sides(sites, routes, excluded, least, digits))
    return out.select("source_qualified_name", "route_qn", "url_path", "route_path", F.col("call_method").alias("method"), F.col("shown").alias("confidence"), "band", "type")


def _folder(qualified_name: Column) -> Column:
    return F.regexp_extract(qualified_name, r"^(.+)\.[^.]*\.[^.]*$", 1)


def same_service(a: Column, b: Column) -> Column:
    """Whether two qualified names lie in one folder: what stands before their last two
    parts, module and name, is the same, and there is something."""
    return (_folder(a) != "") & (_folder(a) == _folder(b))


def protocol(text: Column | str) -> Column:
    """ws or sse where a handler's source shows it, else empty."""
    shown = lambda words: any_of([F.contains(F.col(text) if isinstance(text, str) else text, F.lit(w)) for w in words])
    return F.when(shown(SOCKET_WORDS), "ws").when(shown(EVENT_WORDS), "sse").otherwise("")


def links(sites: DataFrame, routes: DataFrame, graph: Graph, least: float = LEAST_SCORE, excluded: tuple[str, ...] = EXCLUDED_PATHS) -> DataFrame:
    """(project, source_id, target_id, type, p): what `match` finds between nodes, with the
    path, method, confidence and its band (p); of several matches of a pair the most certain.

    Ids are looked up before pairs are made. Of a source with one site and a name with one
    route there is but one match, so that only pairs of the others are shuffled.
    """
    ids = graph.nodes.select("project", "qualified_name", "id")
    s, r, classes = _sides(sites, routes, excluded, least, 4)
    s = s.join(ids.select("project", F.col("qualified_name").alias("source_qualified_name"), F.col("id").alias("source_id")), "source_qualified_name").drop("source_qualified_name", "source_label")
    r = r.join(ids.select(F.col("qualified_name").alias("route_qn"), F.col("id").alias("target_id")), "route_qn").drop("route_qn", "route_path", "route_method")
    parted = lambda rows, key: [rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_k")), key).where(w).drop("_k") for w in ("_k = 1", "_k > 1")]
    (s_one, s_more), (r_one, r_more) = parted(s, "source_id"), parted(r, "target_id")
    key = ["project", "source_id", "target_id", "type"]
    found = lambda a, b: _pairs(a, b, classes)
    props = F.struct("url_path", F.col("call_method").alias("method"), F.col("shown").alias("confidence"), F.col("band").alias("confidence_band"))
    several = found(s_more, r).unionByName(found(s_one, r_more)).groupBy(*key).agg(F.max_by(props, F.struct("confidence", "url_path")).alias("p"))
    return found(s_one, r_one).select(*key, props.alias("p")).unionByName(several)


def link_edges(sites: DataFrame, routes: DataFrame, graph: Graph, least: float = LEAST_SCORE, excluded: tuple[str, ...] = EXCLUDED_PATHS) -> DataFrame:
    """HTTP_CALLS and ASYNC_CALLS edges of `links`."""
    rows = links(sites, routes, graph, least, excluded)
    return rows.select(F.xxhash64("type", "source_id", "target_id").alias("id"), "project", "source_id", "target_id", "type", F.to_json("p").alias("properties"))
