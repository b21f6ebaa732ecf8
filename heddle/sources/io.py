"""Sources and sinks: JSONL with a quarantine, partitioned tables, exports with a manifest, price files, listings."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_SCHEMA = "block_id string, source_id string, idx long, text string, page_start int, page_end int, heading_path array<string>, kind string"
EVIDENCE_SCHEMA = "evidence_id string, source_id string, block_id string, excerpt string, claim string, confidence double, contrast struct<a: string, b: string>"
EVENT_SCHEMA = "event_id string, occurred_at timestamp, name string, user_id string, anon_id string, project_id string, session_id string, environment string, is_synthetic boolean, event_version int, properties_json string"
PRICE_SCHEMA = "provider string, model string, operation string, effective_from timestamp, input_per_million long, output_per_million long, cached_per_million long, per_call long"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSONL files; blank lines are skipped, nothing is inferred."""
    declared = T.StructType.fromDDL(schema)
    with_bad = T.StructType([*declared.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select(F.col("r._bad").alias("line"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_blocks(df: DataFrame, path: str) -> None:
    """Idempotent by source: only the sources that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def export_with_manifest(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as JSONL under ``path`` and returns the manifest: table, rows."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        part = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file (TOML, an array of tables named price) as a small dimension.  Read through Spark, so that any
    file system will do; price files are a few rows by nature."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    rows = [tuple(p.get(k) for k in ("provider", "model", "operation", "effective_from", "input_per_million", "output_per_million", "cached_per_million", "per_call")) for p in tomllib.loads(text).get("price", [])]
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def list_documents(spark: SparkSession, root: str, pattern: str = "*.{md,txt,html}") -> DataFrame:
    """Paths, sizes and times of documents under a folder, at any depth; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", "modificationTime")


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Whole files as text; a byte-order mark goes, bytes that are no valid text give null."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.decode("content", encoding) if encoding != "UTF-8" else F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def upgraded_evidence(df: DataFrame, locators: DataFrame) -> DataFrame:
    """Lifts evidence whose items are plain strings to items with ids and the locator of their block.

    ``df``: block_id, items array<string>; ``locators``: block_id, page_start.  A block without a locator keeps its
    items with a null page."""
    item = F.posexplode("items").alias("pos", "text")
    key = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("\x1f", "block_id", "text").cast("binary"), 256), 1, 16))
    return df.select("block_id", item).join(locators, "block_id", "left").select("block_id", key.alias("evidence_id"), "text", "page_start", "pos")
