"""Names, paths and qualified names as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob_to_like(glob: str) -> str:
    """`**/`, `/**` and `*` match anything, `?` one character."""
    return glob.replace("**/", "%").replace("/**", "%").replace("*", "%").replace("?", "_")


def glob_to_regex(glob: str) -> str:
    """Shell style: `*` and `?` stay within a path segment, `**` doesn't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (("\\" + glob[i]) if glob[i] in r".^$+{}[]()|\\" else glob[i]), i + 1
    return f"^{out}$"


def simple_name(qn: Column | str) -> Column:
    return F.substring_index(_col(qn), ".", -1)


def parent_name(qn: Column | str) -> Column:
    """The qualified name without its last part; empty where there is none."""
    return F.regexp_replace(_col(qn), r"\.?[^.]*$", "")


def package_of(qn: Column | str) -> Column:
    """The third part of four or more, the second of two or three, else empty."""
    parts = F.split(_col(qn), r"\.")
    n = F.size(parts)
    return F.when(n >= 4, F.get(parts, 2)).when(n >= 2, F.get(parts, 1)).otherwise("")


def top_package_of(qn: Column | str) -> Column:
    return F.coalesce(F.get(F.split(_col(qn), r"\."), 1), F.lit(""))


def module_qn(project: Column | str, path: Column | str) -> Column:
    """project.path.parts, without the extension and a last __init__ or index."""
    stem = F.regexp_replace(F.regexp_replace(_col(path), r"\.[^./]*$", ""), r"(^|/)(__init__|index)$", "")
    return F.concat_ws(".", _col(project), F.nullif(F.translate(stem, "/", "."), F.lit("")))


def folder_qn(project: Column | str, path: Column | str) -> Column:
    return F.concat_ws(".", _col(project), F.nullif(F.translate(_col(path), "/", "."), F.lit("")))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """With its dot, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def project_name(path: str) -> str:
    """The project of an absolute path: its parts joined by dashes."""
    return path.strip("/").replace("/", "-").replace(":", "") or "root"


def camel_words(name: Column | str) -> Column:
    """Lower-cased words of a camelCase, snake_case or dotted name."""
    spaced = F.regexp_replace(F.regexp_replace(_col(name), r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def normal_key(name: Column | str) -> Column:
    """A configuration key or a symbol as words joined by underscores."""
    return F.array_join(camel_words(name), "_")


def is_test_path(path: Column | str) -> Column:
    return F.lower(_col(path)).rlike(r"(^|/)(tests?|__tests__|spec|testdata)/|(^|/)test_[^/]*$|(_test|\.test|\.spec|_spec)\.[^/]*$")


def is_test_name(name: Column | str) -> Column:
    return _col(name).rlike(r"^(Test|test_|test[A-Z]|Benchmark|Example|it_|should)")


def ngrams(text: Column | str, n: int) -> Column:
    """Distinct character n-grams; a shorter text has none."""
    text = _col(text)
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def ngram_overlap(a: Column | str, b: Column | str, n: int = 2) -> Column:
    """Common n-grams as a share of the smaller side's; 0 where a side has none."""
    x, y = ngrams(a, n), ngrams(b, n)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def normal_levenshtein(a: Column | str, b: Column | str) -> Column:
    """1 for equal texts, down to 0."""
    most = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(_col(a), _col(b)) / most)


def confidence_band(score: Column, floor: bool = True) -> Column:
    """high from 0.70, medium from 0.45, speculative from 0.25, and below that empty,
    or speculative too where there is no floor."""
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").when((score >= 0.25) | F.lit(not floor), "speculative").otherwise("")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


#: Languages by extension, for file counts.
LANGUAGES = {
    ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".hpp": "C++", ".cs": "C#", ".css": "CSS", ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang",
    ".go": "Go", ".groovy": "Groovy", ".hs": "Haskell", ".html": "HTML", ".java": "Java", ".jl": "Julia", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".json": "JSON", ".kt": "Kotlin", ".kts": "Kotlin", ".lua": "Lua", ".md": "Markdown", ".ml": "OCaml", ".php": "PHP", ".pl": "Perl", ".py": "Python", ".r": "R",
    ".rb": "Ruby", ".rs": "Rust", ".scala": "Scala", ".scss": "SCSS", ".sh": "Bash", ".sql": "SQL", ".swift": "Swift", ".tf": "HCL", ".toml": "TOML", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".vue": "Vue", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".zig": "Zig",
}


def language_of(path: Column | str) -> Column:
    """By extension; null where it is unknown."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, extension(path))
