"""Scanning a source tree."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.iterate import cut
from .ignore import IgnorePatterns, is_binary, pattern_lines

MAX_FILE_SIZE = 1 << 20
WHOLE_UNDER, MAX_LINES = 64 << 10, 10_001
#: Bytes of hidden files that the driver holds at once.
BATCH = 32 << 20


@dataclass
class WalkOptions:
    max_depth: int | None = None
    max_file_size: int = MAX_FILE_SIZE
    read_content: bool = True
    skip_binary: bool = True
    use_gitignore: bool = True
    ignore_file: str = ".gitignore"
    more_ignores: tuple[str, ...] = ()
    follow_symlinks: bool = False


def first_lines(text: Column, size: Column) -> Column:
    """Files of 64 KiB and more are cut after 10,001 lines."""
    lines = F.split(text, "\r\n|\n|\r")
    return F.when(size < WHOLE_UNDER, text).otherwise(F.array_join(F.slice(lines, 1, MAX_LINES), "\n"))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system, system.makeQualified(where)


def _bytes(spark: SparkSession, system, where) -> bytes:
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is no such file."""
    system, where = _file_system(spark, path)
    return _bytes(spark, system, where).decode(errors="replace") if system.exists(where) else None


def ignore_rules(spark: SparkSession, root: str, options: WalkOptions) -> IgnorePatterns:
    """The defaults, the root's ignore files and more patterns."""
    rules = IgnorePatterns()
    if options.use_gitignore:
        for name in dict.fromkeys((".gitignore", options.ignore_file)):
            system, where = _file_system(spark, f"{root.rstrip('/')}/{name}")
            if system.exists(where):
                rules.add_file(_bytes(spark, system, where).decode(errors="replace"))
    for pattern in options.more_ignores:
        rules.patterns += pattern_lines(pattern)
    return rules


def links(top: str, rules: IgnorePatterns, follow: bool) -> list[str]:
    """The symbolic links below a local root that are not to be followed: those to folders always, those to files unless
    ``follow``. Other file systems have none. Only links come to the driver, and no ignored folder is gone into."""
    if not top.startswith("file:"):
        return []
    top, out = _scheme_free(top).rstrip("/"), []
    for folder, folders, names in os.walk(top):
        prefix = folder.removeprefix(top).lstrip("/")
        path = lambda name: f"{prefix}/{name}" if prefix else name  # noqa: B023, E731
        out += [path(n) for n in folders if os.path.islink(f"{folder}/{n}")]
        out += [path(n) for n in names if os.path.islink(f"{folder}/{n}") and not (follow and os.path.isfile(f"{folder}/{n}"))]
        folders[:] = [n for n in folders if not rules.ignores_path(path(n))]
    return out


def hidden_files(spark: SparkSession, root: str, options: WalkOptions, rules: IgnorePatterns, left_out: frozenset[str] = frozenset()) -> Iterator[list[tuple]]:
    """Files that Spark's sources never list, as their name or a folder of theirs begins with ``_`` or ``.`` - package
    files and test folders among them: (path, size, modified_at, content), in batches of about BATCH bytes, however much
    there is. Folders are listed by the driver, as Spark's own sources are, without going into ignored ones.
    """
    system, top = _file_system(spark, root)
    prefix = top.toString().rstrip("/") + "/"
    out, held, open_now = [], 0, [(top, False)]
    while open_now:
        folder, hidden = open_now.pop()
        for status in system.listStatus(folder):
            path = status.getPath().toString().removeprefix(prefix)
            if path in left_out or rules.ignores_path(path):
                continue
            unseen = hidden or status.getPath().getName().startswith(("_", "."))
            if status.isDirectory():
                open_now.append((status.getPath(), unseen))
            elif unseen:
                size, content = status.getLen(), None
                if options.read_content and size <= options.max_file_size:
                    content = bytearray(_bytes(spark, system, status.getPath()))
                    held += size
                out.append((path, size, datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc), content))
                if held > BATCH or len(out) >= 10_000:
                    yield out
                    out, held = [], 0
    if out:
        yield out


def walk(spark: SparkSession, root: str, options: WalkOptions | None = None) -> DataFrame:
    """Every file below ``root`` that is not ignored: ``path`` (relative), ``size``, ``modified_at``, ``is_binary``,
    ``status`` (``read``, ``too_large``, ``binary``, ``listed``) and ``content`` (null unless read).

    Contents that nobody asks for are not read by the source.
    """
    options = options or WalkOptions()
    rules = ignore_rules(spark, root, options)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    _, top = _file_system(spark, root)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    relative = F.regexp_replace(plain, "^" + _quoted(_scheme_free(top.toString().rstrip("/"))) + "/", "")
    listed = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    left_out = links(top.toString(), rules, options.follow_symlinks)
    if left_out:
        known = spark.createDataFrame([(p,) for p in left_out], "above string")
        below = listed.select("path", F.explode(paths.prefixes(F.col("path"))).alias("above")).join(known, "above", "left_semi").select("path").distinct()
        listed = listed.join(below, "path", "left_anti")
    more = hidden_files(spark, root, options, rules, frozenset(left_out))
    batch = next(more, None)
    while batch:
        made, batch = spark.createDataFrame(batch, "path string, size bigint, modified_at timestamp, content binary"), next(more, None)
        listed = listed.unionByName(cut(made))
    return of_files(listed, options, rules)


def _scheme_free(path: str) -> str:
    return re.sub(r"^[a-z]+:/*(?=/)", "", path)


def _quoted(path: str) -> str:
    return "\\Q" + path + "\\E"


def of_files(files: DataFrame, options: WalkOptions | None = None, rules: IgnorePatterns | None = None) -> DataFrame:
    """The same over rows of ``path``, ``size``, ``modified_at`` and ``content`` (bytes)."""
    options, rules = options or WalkOptions(), rules or IgnorePatterns()
    kept = files.where(~rules.ignores(F.col("path")))
    if options.max_depth is not None:
        kept = kept.where(F.size(paths.parts(F.col("path"))) - 1 <= options.max_depth)
    large = F.col("size") > options.max_file_size
    if not options.read_content:
        status = F.when(large, "too_large").otherwise("listed")
        return kept.select("path", "size", "modified_at", F.lit(None).cast("boolean").alias("is_binary"), status.alias("status"), F.lit(None).cast("string").alias("content"))
    binary = F.when(~large, is_binary(F.col("content")))
    told = kept.withColumn("is_binary", binary)
    status = F.when(large, "too_large").when(F.col("is_binary") & F.lit(options.skip_binary), "binary").otherwise("read")
    told = told.withColumn("status", status)
    text = F.when(F.col("status") == "read", first_lines(F.decode("content", "UTF-8"), F.col("size")))
    return told.select("path", "size", "modified_at", "is_binary", "status", text.alias("content"))


def walk_stats(walked: DataFrame) -> DataFrame:
    """One row."""
    kept = F.col("status").isin("read", "listed")
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias(name)
    return walked.agg(F.count(F.when(kept, 1)).alias("total_files"), total(kept, "total_size"), F.count(F.when(~kept, 1)).alias("skipped_files"), total(~kept, "skipped_size"))
