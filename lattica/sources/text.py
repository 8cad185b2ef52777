"""Line-oriented sources: files as lines, git logs and git diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Files that change coupling doesn't look at.
UNTRACKED = r"(^|/)(node_modules|vendor|dist|build|target|\.git|__pycache__)/|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|go\.sum|poetry\.lock)$|\.(min\.js|map|lock|png|jpe?g|gif|svg|ico|pdf|zip|gz)$"


def lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, with its number from 1; the other columns stay."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(F.split(text, "\n")).alias("_n", "content")).select(*rest, (F.col("_n") + 1).alias("line"), "content")


def numbered(spark: SparkSession, content: str) -> DataFrame:
    """(line, content) of one text, such as the output of a command."""
    return lines(spark.createDataFrame([(content,)], "text string"))


def carried(value: Column, order: str, *within: str) -> Column:
    """The last value that isn't null up to this line."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def git_log(log: DataFrame, *within: str) -> DataFrame:
    """(within, hash, file) of `git log --name-only --pretty=format:COMMIT:%H` as lines."""
    found = F.nullif(F.regexp_extract("content", r"^COMMIT:([0-9a-f]+)", 1), F.lit(""))
    rows = log.withColumn("hash", carried(found, "line", *within)).where(found.isNull() & (F.trim("content") != "") & F.col("hash").isNotNull())
    return rows.select(*within, "hash", F.trim("content").alias("file")).where(~F.col("file").rlike(UNTRACKED)).distinct()


def git_hunks(diff: DataFrame, *within: str) -> DataFrame:
    """(within, path, start_line, end_line) of `git diff --unified=0` as lines: the new
    side of every hunk, in the last file named before it. Deletions count as their
    line; files that are gone have no hunks."""
    named = F.when(F.startswith("content", F.lit("+++ ")), F.regexp_extract("content", r"^\+\+\+ (?:b/)?(.*)$", 1))
    head = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    rows = diff.withColumn("path", carried(named, "line", *within)).where(F.col("content").rlike(head) & (F.col("path") != "/dev/null"))
    start = F.regexp_extract("content", head, 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("content", head, 2), F.lit("")).cast("int"), F.lit(1))
    return rows.select(*within, "path", start.alias("start_line"), (start + F.greatest(count, F.lit(1)) - 1).alias("end_line"))


def git_names(status: DataFrame, *within: str) -> DataFrame:
    """(within, status, path, old_path) of `git diff --name-status` as lines."""
    parts = F.split("content", "\t")
    letter = F.substring(F.get(parts, 0), 1, 1)
    moved = letter.isin("R", "C")
    rows = status.where(F.col("content").rlike(r"^[A-Z]\d*\t"))
    return rows.select(*within, letter.alias("status"), F.when(moved, F.get(parts, 2)).otherwise(F.get(parts, 1)).alias("path"), F.when(moved, F.get(parts, 1)).alias("old_path"))


def env_bindings(files: DataFrame) -> DataFrame:
    """The columns of files but their text, key and value of URLs that Dockerfiles, YAML, HCL, shell and dotenv files
    set; names and values that look like secrets are left out."""
    rest = [c for c in files.columns if c != "text"]
    rows = lines(files)
    pattern = r"""^\s*(?:-\s+)?(?:export\s+|ENV\s+|ARG\s+|set\s+)?["']?([A-Za-z_][A-Za-z0-9_.\-]*)["']?\s*(?:=|:|\s)\s*["']?(https?://[^\s"'#,]+)"""
    found = rows.select(*rest, F.regexp_extract("content", pattern, 1).alias("key"), F.regexp_extract("content", pattern, 2).alias("value")).where("key <> ''")
    return found.where(~is_secret("key", "value")).distinct()


def is_secret(key: Column | str, value: Column | str) -> Column:
    """Keys that name credentials, and values that hold some."""
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return F.lower(key).rlike(r"secret|passw|token|credential|api_?key|private_?key|auth") | value.rlike(r"://[^/\s:]+:[^/\s@]+@|AKIA[0-9A-Z]{16}|-----BEGIN|ghp_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{20,}\.")
