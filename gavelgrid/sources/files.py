"""Shards, manifests, query sets, case files and fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any storage Spark reads, sorted; none if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    storage = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in storage.listStatus(path)) if storage.exists(path) else []


def shard_files(root: str, courts: Iterable[str] | None = None) -> list[str]:
    """Sorted parquet shards below ``root/data`` without deltas, and those that lie only in ``root``."""
    spark = SparkSession.builder.getOrCreate()
    shards = lambda folder: {n: f"{folder}/{n}" for n in list_names(spark, folder) if n.endswith(".parquet") and not n.startswith("delta-")}
    every = {**shards(root), **shards(f"{root}/data")}
    wanted = set(courts) if courts is not None else None
    return [every[n] for n in sorted(every) if wanted is None or n.removesuffix(".parquet") in wanted]


def has_columns(spark: SparkSession, path: str, columns: Iterable[str]) -> bool:
    """Schema probe: only metadata is read."""
    return set(columns) <= set(spark.read.parquet(path).columns)


def read_widened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards of growing schemas as one table; columns a shard lacks are NULL."""
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot, date, path, sha256) of a manifest with a snapshot date and dated deltas."""
    schema = "snapshot string, deltas array<struct<date:string,path:string,sha256:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("snapshot", F.inline("deltas"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, tags, relevant) from JSON lines or a JSON array; relevant ids with a grade, 1 if none is given."""
    schema = "id string, query string, question string, tags array<string>, relevant array<struct<id:string,grade:int>>"
    multi = Path(path).suffix == ".json"
    rows = spark.read.schema(schema).option("multiLine", multi).json(path)
    graded = F.transform(F.coalesce("relevant", F.array().cast("array<struct<id:string,grade:int>>")), lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["grade"], F.lit(1)).alias("grade")))
    return rows.select(F.col("id"), F.coalesce("query", "question").alias("query"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), graded.alias("relevant"))


def read_cases(spark: SparkSession, paths: list[str], suite: str | None = None) -> DataFrame:
    """Case files (YAML, read on the driver: they are written by hand) as (id, suite, question, reference, rubric)."""
    import yaml

    rows = []
    for path in sorted(paths):
        for case in yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []:
            if suite is None or case.get("suite") == suite:
                rows.append((str(case["id"]), case.get("suite"), case.get("question"), case.get("reference"), [str(x) for x in case.get("rubric") or []]))
    return spark.createDataFrame(rows, "id string, suite string, question string, reference string, rubric array<string>")


def sha256_of(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while part := file.read(block):
            digest.update(part)
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, computed by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def cached_run(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored result at ``path``, computed and written first if there is none."""
    if "_SUCCESS" not in list_names(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, config: dict) -> None:
    """A report as JSON, in a folder named by its configuration, so that a resumed run can't mix configurations."""
    name = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
    df.write.mode("overwrite").json(f"{path}/config={name}")


def page_to_text(elements: Column) -> Column:
    """Markdown of a parsed page, array<struct<type, level, text>>: headings, bullets, no headers, footers, pictures."""
    kept = F.filter(elements, lambda e: ~e["type"].isin("page_header", "page_footer", "picture") & (F.trim(e["text"]) != ""))
    line = lambda e: F.when(e["type"] == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(e["level"], F.lit(1))), F.lit(" "), e["text"])).when(e["type"] == "list_item", F.concat(F.lit("- "), e["text"])).otherwise(e["text"])
    return F.array_join(F.transform(kept, line), "\n\n")
