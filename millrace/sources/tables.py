"""Reading and writing the library's own tables: flows, labels, metrics, embeddings, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.contract import coerce, core_schema

METRICS_SCHEMA = "config struct<tool:string,regime:string,model:string,task:string,split:string,seed:int,dataset:string,n_features:int>, n_train bigint, n_test bigint, metrics struct<macro_f1:double,weighted_f1:double,balanced_accuracy:double,per_class:map<string,struct<precision:double,recall:double,`f1-score`:double,support:double>>,fpr:double,attack_recall:double,attack_precision:double,auc_pr:double,confusion_matrix:array<array<bigint>>,class_order:array<string>>, wall_seconds double"


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Canonical flows: columns that files lack are null, types are coerced, columns outside the contract are an error."""
    return coerce(spark.read.option("mergeSchema", True).parquet(path))


def read_core(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(core_schema()).parquet(path)


def tool_flows(spark: SparkSession, path: str, tool: str, dataset: str, captures: Sequence[str] | None = None) -> DataFrame:
    """All captures of one tool, tagged ``_capture``; an error if there is none."""
    df = spark.read.option("mergeSchema", True).parquet(path).where((F.col("tool") == tool) & (F.col("dataset") == dataset))
    df = (df.where(F.col("capture").isin(list(captures))) if captures else df).withColumn("_capture", F.col("capture"))
    if df.limit(1).count() == 0:
        raise ValueError(f"no flows of {tool} in {dataset}")
    return df


def alignment_columns(flows: DataFrame) -> DataFrame:
    """S3: the eight columns that alignment reads; the scan prunes the rest."""
    return flows.select("src_ip", "src_port", "dst_ip", "dst_port", "proto", "t_start", "t_end", "label")


def read_assembled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Assembled flows whose list cells are joined by blanks; packet bytes are blocks of hex digits."""
    df = spark.read.csv(path, header=True)

    def numbers(c: str, kind: str) -> Column:
        return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast(kind)))

    lists = {"dirs": "int", "times": "double", "sizes": "int"}
    counts = {"flow_id": "bigint", "src_port": "int", "dst_port": "int", "proto": "int"} | dict.fromkeys(("n_pkts", "n_bytes", "pkts_fwd", "pkts_bwd", "bytes_fwd", "bytes_bwd", "seq_len"), "bigint") | dict.fromkeys(("t_start", "t_end", "duration"), "double")

    def blocks(c: str) -> Column:
        return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.array().cast("array<binary>")).otherwise(F.transform(F.split(F.trim(c), r"\s+"), lambda x: F.unhex(x)))

    return df.select(*[blocks(c).alias(c) if c == "bytes" else numbers(c, lists[c]).alias(c) if c in lists else F.col(c).try_cast(counts[c]).alias(c) if c in counts else F.col(c) for c in df.columns])


def read_labelled_csv(spark: SparkSession, path: str, header: bool, columns: Mapping[str, int], time_format: str = "dd/MM/yyyy hh:mm:ss a") -> DataFrame:
    """Labelled flows with or without header, fields by position; rows that are too short or have no time go."""
    lines = spark.read.csv(path, header=header)
    names = lines.columns
    out = lines.select(*[F.col(f"`{names[i]}`").alias(f) for f, i in columns.items() if i < len(names)])
    t = F.coalesce(F.try_to_timestamp("time", F.lit(time_format)), F.try_to_timestamp("time", F.lit("dd/MM/yyyy HH:mm:ss")))
    return out.withColumn("t", F.unix_micros(t) / 1e6).where("t IS NOT NULL AND stage IS NOT NULL")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result CSVs."""
    return spark.read.csv(path, schema=schema, header=True)


def read_embeddings(spark: SparkSession, vectors: str, meta: str, key: str = "flow_id") -> DataFrame:
    """Vectors joined to their rows; a vector or row without the other is an error; a null label is BENIGN."""
    v, m = spark.read.parquet(vectors), spark.read.parquet(meta)
    odd = v.join(m, key, "left_anti").select(key).union(m.join(v, key, "left_anti").select(key)).count()
    if odd:
        raise ValueError(f"{odd} rows have no partner")
    return v.join(m, key).withColumn("label", F.coalesce("label", F.lit("BENIGN")))


def reference_events(spark: SparkSession, path: str, capture: str) -> DataFrame:
    """Reference events of one capture whose ports and protocol are numbers."""
    df = spark.read.parquet(path).where(F.col("_capture") == capture)
    for c in ("src_port", "dst_port", "proto"):
        df = df.withColumn(c, F.col(c).try_cast("int"))
    return df.dropna(subset=["src_port", "dst_port", "proto"])


def captures_table(spark: SparkSession, spec: Mapping[str, Mapping[str, Sequence[str]]], files: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """(dataset, capture, file, split) from {dataset: {split: captures}}."""
    rows = [(d, c, files.get(c), s) for d, splits in spec.items() for s, caps in splits.items() for c in caps]
    return spark.createDataFrame(rows, "dataset string, capture string, file string, split string")


def provenance(spark: SparkSession, tool: str, version: str, config: Mapping[str, str], rows: int, fingerprint: str) -> DataFrame:
    """K2: one provenance row; the config's hash is the first 16 hex digits over its sorted entries."""
    df = spark.createDataFrame([(tool, version, dict(config), rows, fingerprint)], "tool string, version string, config map<string,string>, n_rows bigint, fingerprint string")
    entries = F.array_sort(F.map_entries("config"))
    return df.withColumn("config_hash", F.substring(F.sha2(F.to_json(entries), 256), 1, 16))


def not_done(df: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not recorded yet."""
    return df if done is None else df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str], done: DataFrame | None = None) -> None:
    """K5: append the rows of keys that ``done`` lacks."""
    not_done(df, done, keys).write.mode("append").parquet(path)


def write_labeled(df: DataFrame, path: str, done: DataFrame | None = None, force: bool = False) -> None:
    """K4: labeled flows by dataset, tool and capture; those there already stay unless ``force``."""
    parts = ["dataset", "tool", "capture"]
    rows = df if force else not_done(df, done, parts)
    rows.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """K6: append metrics records."""
    rows.write.mode("append").json(path)


def write_sample(df: DataFrame, mask: Column, path: str, mask_path: str | None = None, keys: Sequence[str] = ("flow_id",)) -> None:
    """K7: the rows of a mask, and with ``mask_path`` every row's key and whether it was taken."""
    marked = df.withColumn("sampled", F.coalesce(mask, F.lit(False)))
    if mask_path:
        marked.select(*keys, "sampled").write.mode("overwrite").parquet(mask_path)
    marked.where("sampled").drop("sampled").write.mode("overwrite").parquet(path)


def write_embeddings(df: DataFrame, path: str, wall_s: float, vector: str = "embedding", memory_gb: float | None = None) -> DataFrame:
    """K8: vectors, and their cost row: flows, seconds, dimension, whether any value is NaN, bytes stored, peak memory as measured by the caller."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    stored = back.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0] or 0
    return back.agg(F.count(F.lit(1)).alias("flows"), F.lit(wall_s).alias("wall_s"), F.max(F.size(vector)).alias("dim"), F.max(F.exists(vector, lambda x: F.isnan(x))).alias("any_nan"), F.lit(stored).cast("bigint").alias("stored_bytes"), F.lit(memory_gb).cast("double").alias("memory_gb"))
