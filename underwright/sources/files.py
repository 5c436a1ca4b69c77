"""CSV, Parquet and JSON files, and fitted models on disk."""

from __future__ import annotations

import json
import platform
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from underwright.sources.contract import APPLICANT_DDL, ID

ARTIFACT_VERSION = "1.0.0"
CORRUPT = "_corrupt_record"
METADATA_DDL = (
    "artifact_version string, model_type string, created_at_utc string, environment map<string,string>, decision_threshold double, "
    "metrics map<string,map<string,double>>, n_features int, features array<string>, params map<string,string>, extra map<string,string>")


def scan_csv(spark: SparkSession, path: str, ddl: str = APPLICANT_DDL, keep_corrupt: bool = False) -> DataFrame:
    """CSV with a header under a declared schema.

    A line that does not parse fails the read, or with ``keep_corrupt`` is a row with its text in one more column.
    """
    rows = spark.read.option("header", True)
    if not keep_corrupt:
        return rows.schema(ddl).option("mode", "FAILFAST").csv(path)
    return rows.schema(f"{ddl}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def text_ddl(ddl: str = APPLICANT_DDL) -> str:
    """The same columns, all read as text."""
    return ", ".join(f"`{field.name}` string" for field in StructType.fromDDL(ddl))


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sink_split(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """Small artifact (selected features, best parameters) as one JSON line."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()["value"])


def model_metadata(spark: SparkSession, model_type: str, threshold: float, metrics: Mapping[str, Mapping[str, float]],
                   features: Sequence[str], params: Mapping[str, object], extra: Mapping[str, object] | None = None) -> DataFrame:
    """One row that describes a fitted model."""
    environment = {"python": platform.python_version(), "spark": pyspark.__version__}
    row = (ARTIFACT_VERSION, model_type, datetime.now(timezone.utc).isoformat(), environment, float(threshold),
           {k: {m: float(v) for m, v in part.items()} for k, part in metrics.items()}, len(features), list(features),
           {k: str(v) for k, v in params.items()}, {k: str(v) for k, v in (extra or {}).items()})
    return spark.createDataFrame([row], METADATA_DDL)


def save_model(model: PipelineModel, path: str, metadata: DataFrame | None = None) -> None:
    """Fitted stages under ``path``/model, the metadata row beside them."""
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Fitted stages and metadata; a missing model is an error, missing metadata is empty."""
    if not exists(spark, f"{path}/model"):
        raise FileNotFoundError(f"no model under {path}")
    metadata = {}
    if exists(spark, f"{path}/metadata"):
        metadata = spark.read.schema(METADATA_DDL).json(f"{path}/metadata").first().asDict(recursive=True)
    return PipelineModel.load(f"{path}/model"), metadata


def reload_parity(before: DataFrame, after: DataFrame, id_col: str = ID, tolerance: float = 1e-9) -> DataFrame:
    """Largest difference between two score sets of the same rows."""
    joined = before.selectExpr(id_col, "p AS p1").join(after.selectExpr(id_col, "p AS p2"), id_col, "full")
    return joined.agg(F.expr("count(*) AS n"), F.expr("count_if(p1 IS NULL OR p2 IS NULL) AS unmatched"),
                      F.expr("max(abs(p1 - p2)) AS max_difference")).selectExpr(
        "n", "unmatched", "max_difference", f"unmatched = 0 AND max_difference < {tolerance}D AS equal")
