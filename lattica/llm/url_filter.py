"""Allow and block rules for URLs, kept in a sorted digest array (operator 6).

Rules are 64-bit xxhash keys of host and path, sorted in one file beside the full
strings. Workers map the file into memory and probe it by vectorised binary
search; a key that matches is confirmed against the stored string, so a collision
decides nothing.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map

#: The rules of op6, in the order given: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_MAGIC = b"LURL0002"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def write_rules(path: str, rules: Iterable[tuple[str, str]], key=digest) -> None:
    """The rule file: magic, number of rules, lengths of hosts and of paths in use, then
    sorted keys, offsets into the strings, verdicts and strings. Of equal rules the last
    holds."""
    last = {rule: verdict for verdict, rule in rules}
    found = sorted((key(rule), rule, verdict) for rule, verdict in last.items())
    strings = [rule.encode() for _, rule, _ in found]
    hosts = sorted({len(rule.partition("/")[0]) for rule in last})
    spans = sorted({len(rule) - rule.find("/") if "/" in rule else 0 for rule in last})
    with open(path, "wb") as out:
        out.write(_MAGIC + struct.pack("<QQQ", len(found), len(hosts), len(spans)))
        out.write(np.array(hosts + spans, "<u4").tobytes() + b"\0" * (-4 * len(hosts + spans) % 8))
        out.write(np.array([k for k, _, _ in found], "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, strings)]).astype("<u8").tobytes())
        out.write(bytes(v == "block" for _, _, v in found))
        out.write(b"".join(strings))


class RuleArray:
    """A rule file, mapped into memory: workers of one machine share its pages."""

    def __init__(self, path: str, key=digest):
        self.key = key
        data = np.memmap(path, np.uint8, "r")
        assert data[:8].tobytes() == _MAGIC, path
        n, hosts, spans = struct.unpack("<QQQ", data[8:32].tobytes())
        at, sizes = 32, 4 * (hosts + spans)
        both = data[at : at + sizes].view("<u4").tolist()
        self.hosts, self.spans = both[:hosts], both[hosts:]
        at += sizes + (-sizes % 8)
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.block, self.strings = data[at : at + n], data[at + n :]

    def candidates(self, host: str, path: str) -> list[str]:
        """Every rule that could fit: a suffix of the host at a label and a prefix of the
        path, both of a length that some rule has, whatever the host's number of
        labels. Longest first."""
        n = len(host)
        hosts = [host[n - k :] for k in self.hosts if 0 < k == n or 0 < k < n and host[n - k - 1] == "."]
        found = {h + path[:s] for h in hosts for s in self.spans if len(path) >= s}
        return sorted(found, key=lambda c: (-len(c), c))

    def match(self, pairs: list[tuple[str, str]]) -> list[tuple[str | None, bool]]:
        """For each (host, path) the longest rule that fits and whether it blocks."""
        lists = [self.candidates(*p) for p in pairs]
        flat = [c for one in lists for c in one]
        hit: list[int] = [-1] * len(flat)
        if flat and len(self.keys):
            keys = np.array([self.key(c) for c in flat], np.uint64)
            at = np.searchsorted(self.keys, keys)
            for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
                j, wanted = int(at[i]), flat[i].encode()
                while j < len(self.keys) and self.keys[j] == keys[i]:  # rules whose keys collide stand side by side
                    if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == wanted:
                        hit[i] = j
                        break
                    j += 1
        out, start = [], 0
        for one in lists:
            best = next((i for i in range(start, start + len(one)) if hit[i] >= 0), None)
            out.append((None, False) if best is None else (flat[best], bool(self.block[hit[best]])))
            start += len(one)
        return out


_sent: dict[tuple[str, str], str] = {}


def _distributed(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """The name of the rules' file among Spark's files; equal rules are sent once. The
    driver serves it from a folder of its own, which goes when the driver ends."""
    key = spark.sparkContext.applicationId, hashlib.sha256(repr(rules).encode()).hexdigest()
    if key not in _sent:
        folder = tempfile.mkdtemp(prefix="lattica-rules-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = f"rules-{key[1][:32]}.bin"
        write_rules(os.path.join(folder, name), rules)
        spark.sparkContext.addFile(os.path.join(folder, name))
        _sent[key] = name
    return _sent[key]


@lru_cache(maxsize=4)
def _opened(name: str) -> RuleArray:
    return RuleArray(SparkFiles.get(name))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url).

    A rule is a host and a path written together ("net/es/"): it fits its host and
    all subdomains where the url's path starts with the rule's; the longest that
    fits decides, without one `default` does. A null url, or one without `://`,
    has empty host and path and takes the default, as does an empty host. Repeated
    rows are judged each; an empty table gives an empty result; other columns are
    ignored. The rule file travels to each executor once, through Spark's files.
    """
    name = _distributed(spark, list(rules))

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        pairs = [split_url(url) for url in batch.column(1).to_pylist()]
        found = _opened(name).match(pairs)
        yield {
            "page_id": batch.column(0),
            "host": [h for h, _ in pairs],
            "path": [p for _, p in pairs],
            "rule": [rule for rule, _ in found],
            "verdict": [default if rule is None else ("block" if block else "allow") for rule, block in found],
        }

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rows, "page_id long, host string, path string, rule string, verdict string", 4096)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
