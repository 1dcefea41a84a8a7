"""Corpus scan: which files are candidates, and why the others are not."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: File endings taken when no patterns are given (fixed values).
DEFAULT_INCLUDE = ["*.xmi", "*.uml", "*.ecore", "*.archimate", "*.xml", "*.json", "*.bpmn"]


def _regex(pattern: str) -> str:
    """A shell pattern as a regular expression that Java reads as well."""
    return fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?s:", "(?s)(?:")


def matches(patterns: list[str], relpath: Column, name: Column) -> Column:
    """Whether any pattern fits the name or the relative path, without regard to case; no patterns fit all.

    ``a/**`` also fits every path that starts with ``a``.  Absolute paths are not tried: a corpus under a folder that
    a pattern names would be rejected whole.  All patterns are compiled once into two expressions."""
    if not patterns:
        return F.lit(True)
    rel, low = F.lower(relpath), F.lower(name)
    found = F.lit(False)
    for p in (p.lower() for p in patterns):
        if "**" in p:
            prefix = p.split("**")[0].rstrip("/")
            if prefix:
                found = found | F.startswith(rel, F.lit(prefix))
            found = found | rel.rlike(_regex(p.replace("**", "*")))
        found = found | low.rlike(_regex(p)) | rel.rlike(_regex(p))
    return found


def extension(name: Column) -> Column:
    """The ending with its dot, case kept; ``.noext`` for none."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(ext == "", ".noext").otherwise(ext)


def model_id(sha: Column, relpath: Column) -> Column:
    """First 16 hex digits of the content hash, else of the path's."""
    return F.substring(F.coalesce(sha, F.sha2(relpath.cast("binary"), 256)), 1, 16)


def scan(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, limit_mb: float | None = None) -> DataFrame:
    """``relpath, name, ext, length, sha256, status, representative``, one row per file.

    status: filtered, unreadable (null content), too_large, duplicate (not the first path of its bytes) or candidate.
    Only files that get that far are hashed.
    """
    take = matches(DEFAULT_INCLUDE if include is None else include, F.col("relpath"), F.col("name"))
    if exclude:
        take = take & ~matches(exclude, F.col("relpath"), F.col("name"))
    large = F.col("length") > F.lit(int(limit_mb * 1024 * 1024)) if limit_mb else F.lit(False)
    status = F.when(~take, "filtered").when(F.col("content").isNull(), "unreadable").when(large, "too_large")
    sha = F.when(F.col("_s").isNull(), F.sha2(F.col("content").cast("binary"), 256))
    seen = files.withColumn("_s", status).select("relpath", "name", extension(F.col("name")).alias("ext"), "length", sha.alias("sha256"), "_s")
    first = seen.where("sha256 is not null").groupBy("sha256").agg(F.min("relpath").alias("representative"))
    return seen.join(first, "sha256", "left").select(
        "relpath", "name", "ext", "length", "sha256",
        F.coalesce("_s", F.when(F.col("relpath") == F.col("representative"), "candidate").otherwise("duplicate")).alias("status"), "representative",
    )


def extension_histogram(scanned: DataFrame) -> DataFrame:
    return scanned.where("status <> 'filtered'").groupBy("ext").agg(F.count("*").alias("n_files"))


def duplicate_groups(scanned: DataFrame) -> DataFrame:
    """Hash, size and sorted members of each group of equal files.  The lists are the result; a caller that needs
    sizes only should count."""
    return (
        scanned.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("relpath")).alias("members"))
        .where("n_files > 1")
    )


def totals(scanned: DataFrame) -> DataFrame:
    kinds = ("candidate", "unreadable", "too_large", "filtered", "duplicate")
    return scanned.agg(F.count("*").alias("total_seen"), *[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in kinds])


def browse(scanned: DataFrame, status: str | None = None, text: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of files by path, with the number that match."""
    found = scanned.where(F.contains(F.lower("relpath"), F.lit(text.lower())))
    if status:
        found = found.where(F.col("status") == status)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("relpath").offset(max(0, offset)).limit(min(2000, max(1, limit)))
    return page.crossJoin(F.broadcast(total)).select("relpath", "length", "status", "total")


def browse_duplicates(groups: DataFrame, text: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of groups of which any member matches."""
    found = groups.where(F.exists("members", lambda m: F.contains(F.lower(m), F.lit(text.lower()))))
    return found.orderBy("sha256").offset(max(0, offset)).limit(min(2000, max(1, limit)))
