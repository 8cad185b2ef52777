"""Routes that Go code registers by calls: groups in variables, nested blocks, mounts.

A function's text becomes a table of tokens in order: blocks that a router opens, groups
that variables hold, routes, calls that hand a group on, and braces. Strings and comments
are tokens too, so that what stands in them isn't read. Braces give a running depth, and
the blocks that enclose a route give its prefix; outside of blocks the group of its
variable does, and groups of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .nesting import enclosing, running_depth

_NAME = r"[A-Za-z_]\w*"
#: Verbs that routers have as methods, in their two spellings, and those for any method.
VERBS = ("Get", "Post", "Put", "Delete", "Patch", "Head", "Options")
ANY = ("Any", "Handle", "HandleFunc")
_METHOD = "|".join((*VERBS, *(v.upper() for v in VERBS), *ANY))
#: Packages whose functions look like routes but send requests.
_CLIENTS = ("http", "client", "resty", "httpclient")

_BLOCK = rf"({_NAME})\.Route\(\s*\"([^\"]*)\"\s*,\s*func\s*\(([^()]*)\)\s*\{{"
_GROUP = rf"({_NAME})\s*:?=\s*({_NAME})\.Group\(\s*\"([^\"]*)\""
_ROUTE = rf"({_NAME})\.({_METHOD})\(\s*\"([^\"]*)\"\s*(?:,\s*(?:[^()\n]*,\s*)?({_NAME}(?:\.{_NAME})*)\s*\))?"
_MOUNT = rf"({_NAME}(?:\.{_NAME})*)\(\s*({_NAME})\.Group\(\s*\"([^\"]*)\"\s*\)"
_HAND = rf"({_NAME}(?:\.{_NAME})*)\(\s*({_NAME})\s*[,)]"
_OTHER = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'|[{}]"
#: In this order: what comes first is what a stretch of text is.
_TOKEN = "|".join((_BLOCK, _GROUP, _ROUTE, _MOUNT, _HAND, _OTHER))
#: Texts without these have no routes and hand no group on.
_RELEVANT = rf"\.(?:{_METHOD}|Route|Group)\("


def tokens(sources: DataFrame) -> DataFrame:
    """(qualified_name, place, kind, variable, verb, text, handler, depth): tokens of Go
    texts (qualified_name, text) in order, with the depth of braces before each."""
    rows = sources.where(F.col("text").rlike(_RELEVANT)).select("qualified_name", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("place", "token"))
    token = F.col("token")
    shape = lambda p: token.rlike(f"^(?:{p})$")
    kind = F.when(shape(_BLOCK), "block").when(shape(_GROUP), "group").when(shape(_ROUTE), "route").when(shape(_MOUNT), "mount").when(shape(_HAND), "hand").otherwise("other")
    rows = rows.withColumn("kind", kind)
    part = lambda kind, pattern, n: (F.col("kind") == kind, F.regexp_extract(token, pattern, n))

    def first(*parts: tuple[Column, Column]) -> Column:
        out = F.lit("")
        for where, value in parts:
            out = F.when(where, value).otherwise(out)
        return out

    rows = rows.withColumns({
        "variable": first(part("block", _BLOCK, 1), part("group", _GROUP, 2), part("route", _ROUTE, 1), part("mount", _MOUNT, 2), part("hand", _HAND, 2)),
        "verb": first(part("group", _GROUP, 1), part("route", _ROUTE, 2), part("mount", _MOUNT, 1), part("hand", _HAND, 1)),
        "text": first(part("block", _BLOCK, 2), part("group", _GROUP, 3), part("route", _ROUTE, 3), part("mount", _MOUNT, 3)),
        "handler": first(part("route", _ROUTE, 4)),
    })
    change = F.when((F.col("kind") == "block") | (token == "{"), 1).when(token == "}", -1).otherwise(0)
    return rows.withColumn("depth", F.greatest(F.lit(0), running_depth(change, "place", "qualified_name")).cast("int")).withColumn("opens", change > 0).drop("token")


def joined(prefix: Column | str, path: Column | str) -> Column:
    """A prefix and a path with one slash between them; an empty path or / gives the prefix."""
    prefix, path = (F.col(c) if isinstance(c, str) else c for c in (prefix, path))
    head, tail = F.rtrim(prefix, F.lit("/")), F.ltrim(path, F.lit("/"))
    return F.when(tail == "", F.when(prefix == "", path).otherwise(prefix)).otherwise(F.concat(head, F.lit("/"), tail))


def _groups(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """(qualified_name, variable, root, prefix): what each group variable of a text stands
    for; groups of groups up to `rounds` deep. Of several assignments the last."""
    own = rows.where("kind = 'group'").groupBy("qualified_name", F.col("verb").alias("variable")).agg(F.max_by(F.struct(F.col("variable").alias("root"), F.col("text").alias("prefix")), "place").alias("g")).select("qualified_name", "variable", "g.root", "g.prefix")
    out = own
    for _ in range(rounds - 1):
        up = own.select("qualified_name", F.col("variable").alias("root"), F.col("root").alias("_root"), F.col("prefix").alias("_prefix"))
        out = out.join(up.where("root <> _root"), ["qualified_name", "root"], "left").select("qualified_name", "variable", F.coalesce("_root", "root").alias("root"), F.when(F.col("_root").isNull(), F.col("prefix")).otherwise(joined("_prefix", "prefix")).alias("prefix"))
    return out


def go_routes(sources: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(qualified_name, method, path, variable, handler) of Go texts (qualified_name, text).
    `variable` is the router, or the one that its groups come from: what another function
    mounts this one under comes before the path."""
    rows = tokens(sources) if rows is None else rows
    absolute = F.startswith("text", F.lit("/"))
    routes = rows.where((F.col("kind") == "route") & ~F.lower("variable").isin(*_CLIENTS) & (absolute | (F.col("handler") != "")))
    marked = rows.withColumn("_opener", F.when(F.col("kind") == "block", F.col("text")).when(F.col("opens"), F.lit("")))
    path = enclosing(marked, ["qualified_name"], "place", "depth", "_opener")
    blocks = F.filter("path", lambda p: p != "")
    prefix = F.aggregate(blocks, F.lit(""), lambda a, b: F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), F.ltrim(b, F.lit("/"))))
    routes = routes.join(path, ["qualified_name", "place"]).withColumns({"_block": prefix, "_in_block": F.size(blocks) > 0}).drop("path")
    routes = routes.join(_groups(rows).select("qualified_name", "variable", "root", F.col("prefix").alias("_group")), ["qualified_name", "variable"], "left")
    # Without a slash it is a path only where the variable is known to be a router.
    routes = routes.where(absolute | (F.col("text") == "") | F.col("_in_block") | F.col("_group").isNotNull())
    full = F.when(F.col("_in_block"), joined("_block", "text")).when(F.col("_group").isNotNull(), joined("_group", "text")).otherwise(F.col("text"))
    method = F.when(F.col("verb").isin(*ANY), "").otherwise(F.upper("verb"))
    return routes.select("qualified_name", method.alias("method"), full.alias("path"), F.coalesce("root", "variable").alias("variable"), "handler", "place").groupBy("qualified_name", "method", "path").agg(F.min("variable").alias("variable"), F.min_by("handler", "place").alias("handler"))


def go_mounts(sources: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(qualified_name, callee, prefix): functions that a text hands a group to, as the call
    names them: a group made in the call, or a variable that holds one."""
    rows = tokens(sources) if rows is None else rows
    made = rows.where("kind = 'mount'").select("qualified_name", F.col("verb").alias("callee"), "variable", F.col("text").alias("prefix"))
    groups = _groups(rows).select("qualified_name", "variable", F.col("prefix").alias("_group"))
    made = made.join(groups, ["qualified_name", "variable"], "left").select("qualified_name", "callee", F.when(F.col("_group").isNull(), F.col("prefix")).otherwise(joined("_group", "prefix")).alias("prefix"))
    handed = rows.where("kind = 'hand'").select("qualified_name", F.col("verb").alias("callee"), "variable").join(groups, ["qualified_name", "variable"]).select("qualified_name", "callee", F.col("_group").alias("prefix"))
    return made.unionByName(handed).distinct()
