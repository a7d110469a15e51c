"""Model manifests and archives as tables: rules, serialisation, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most members and bytes of an archive.
MEMBERS, BYTES = 10_000, 4 << 30
SCHEMA = "model_id string, version string, type string, filename string, license string, url string, sha256 string, source struct<url:string,sha256:string>, runtime struct<format:string,model_name:string,provider:string>"


def parse(rows: DataFrame, json: str) -> DataFrame:
    """rows with manifest, of a JSON text; null where it is none."""
    return rows.withColumn("manifest", F.from_json(json, SCHEMA))


def violation(m: Column) -> Column:
    """The first rule that a manifest breaks, or null. A checksum may stand in source or beside it, but not in both with two values."""
    sha, flat = m["source"]["sha256"], m["sha256"]
    unsafe = lambda c: c.contains("/") | c.contains("\\") | c.isin("", ".", "..") | c.isNull()
    return (
        F.when(m.isNull(), "not_json").when(m["model_id"].isNull() | ~m["model_id"].rlike("^[a-z0-9][a-z0-9._-]{0,127}$"), "model_id").when(unsafe(m["version"]), "version").when(unsafe(m["filename"]), "filename")
        .when(~F.coalesce(m["type"], F.lit("")).isin("file", "archive"), "type").when(sha.isNotNull() & flat.isNotNull() & (sha != flat), "source_conflict")
        .when(~F.coalesce(sha, flat, F.lit("")).rlike("^[0-9a-f]{64}$"), "sha256").when((m["type"] == "archive") & ~m["filename"].rlike(r"\.(zip|tar|tar\.gz|tgz)$"), "archive_suffix")
        .when(F.trim(F.coalesce(m["license"], F.lit(""))) == "", "license").when(m["runtime"].isNotNull() & m["runtime"]["format"].isNull(), "runtime")
    )


def serialise(m: Column) -> Column:
    return F.to_json(m)


def verify(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(model_id, status): verified, missing or checksum_mismatch, of manifests (model_id, filename, sha256) and files (filename, content)."""
    own = files.select("filename", F.sha2("content", 256).alias("__sha"))
    status = F.when(F.col("__sha").isNull(), "missing").when(F.col("__sha") == F.col("sha256"), "verified").otherwise("checksum_mismatch")
    return manifests.join(own, "filename", "left").select("model_id", status.alias("status"))


def archive_violation(members: DataFrame) -> DataFrame:
    """(archive, violation): the first rule, in order of members (archive, ord, path, size, is_link), that an archive breaks, or null."""
    seen = F.row_number().over(Window.partitionBy("archive", "path").orderBy("ord"))
    order = Window.partitionBy("archive").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    path = F.regexp_replace("path", r"\\", "/")
    rows = members.withColumns({"__seen": seen, "__n": F.count("*").over(order), "__bytes": F.sum("size").over(order)})
    wrong = (
        F.when(F.col("__n") > MEMBERS, "too_many_members").when(F.col("is_link"), "link").when(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|/)\.\.(/|$)"), "unsafe_path")
        .when(F.col("__seen") > 1, "duplicate").when(F.col("__bytes") > BYTES, "too_large")
    )
    return rows.withColumn("__wrong", wrong).groupBy("archive").agg(F.min_by("__wrong", F.when(F.col("__wrong").isNotNull(), F.col("ord"))).alias("violation"))
