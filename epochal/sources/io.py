"""Readers and writers (O001-O017, O021, O022, O250)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

INTERVAL = "struct<type:string,start:date,end:date,granularity:string>"
#: Schemas of the artefact tables; readers never infer.
SCHEMAS = {
    "entities": "entity_id string, name string, entity_type string, aliases array<string>, domain string",
    "facts": f"fact_id string, scenario_id string, subject_id string, relation string, object_id string, context_id string, valid_time {INTERVAL}, "
    "publication_time date, transaction_time date, snapshot_visible_from string, source_type string, canonical_evidence string, paraphrased_evidence string",
    "snapshots": "scenario_id string, snapshot_id string, snapshot_time date, visible_fact_ids array<string>, description string",
    "questions": "qid string, scenario_id string, question string, temporal_operator string, gold_answer_entity_ids array<string>, should_abstain boolean, "
    f"program struct<operator:string,relation:string,context_id:string,object_id:string,snapshot_id:string,query_time:{INTERVAL}>",
    "graph_paths": f"pid string, qid string, nodes array<string>, edges array<struct<fact_id:string,relation:string,valid_time:{INTERVAL},traversal_direction:string>>",
    "context_packs": "pack_id string, qid string, scenario_id string, pack_type string, evidence_ids array<string>, expected_behavior string",
}


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Strict rows of JSON lines: a bad row or a missing file is an error, blank lines are skipped (O001)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_bundle(spark: SparkSession, folder: str, names=tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """All tables of a release, also as temporary views (O002)."""
    out = {n: read_jsonl(spark, f"{folder}/{n}.jsonl", SCHEMAS[n]) for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, scenario_id) of a JSON object of arrays."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.explode("m").alias("split", "ids")).select("split", F.explode("ids").alias("scenario_id"))


def read_rows(spark: SparkSession, path: str, schema: str, kind: str, partition: str) -> DataFrame:
    """JSON, JSON-lines, CSV or TSV rows, tagged with the partition they are meant for (O011, O014)."""
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    if kind in ("csv", "tsv"):
        df = r.option("sep", "\t" if kind == "tsv" else ",").csv(path, header=True)
    else:
        df = r.option("multiLine", kind == "json").json(path)
    return df.withColumn("intended_partition", F.lit(partition))


def question_sample(questions: DataFrame, splits: list[str] | None, limit: int | None, salt: str = "question") -> DataFrame:
    """Questions of the splits (array column), the smallest hashes if limited (O007)."""
    q = questions if not splits else questions.where(F.arrays_overlap("splits", F.array(*map(F.lit, splits))))
    return q if limit is None else q.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), "qid"), 256)).limit(limit)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files (O008, O250)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unknown, or differ from the manifest (path, bytes, sha256)."""
    m = manifest.select("path", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"))
    j = files.join(m, "path", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha").isNull(), "unknown").when((F.col("bytes") != F.col("m_bytes")) | (F.col("sha256") != F.col("m_sha")), "changed")
    return j.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def write_jsonl(df: DataFrame, path: str) -> None:
    """The committer renames a finished folder: readers never see half of it (O003)."""
    df.write.mode("overwrite").json(path)


def write_corpus(df: DataFrame, path: str, partition_by: list[str], order: list[str]) -> None:
    """Parquet (zstd), a folder per partition value, rows in order within files (O016)."""
    df.repartition(*partition_by).sortWithinPartitions(*partition_by, *order).write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """A folder per shard; shard: first 8 bytes of sha256(key) modulo shards (O021)."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % shards
    df.withColumn("shard", h.cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def unnest(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows of an array of structs that hold an array (O012)."""
    return df.select("*", F.explode(outer).alias("__o")).select("*", F.explode(f"__o.{inner}").alias("item")).drop("__o")


def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which a left row without partner is an error at run time (O013, O034)."""
    j = left.join(right.withColumn("__found", F.lit(True)), key, "left")
    bad = F.assert_true(F.col("__found").isNotNull(), F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string")))
    return j.where(F.coalesce(bad.cast("boolean"), F.lit(True))).drop("__found")


def cached_or_missing(cache: DataFrame, wanted: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(latest valid cache rows, keys still to compute) (O009, O022)."""
    r = cache.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc()))).where("__r = 1").drop("__r")
    return r.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(r.select(key), key, "left_anti")
