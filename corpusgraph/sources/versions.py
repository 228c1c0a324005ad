"""A table in versions: a new one is written beside the old, and a manifest names the one that counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, folder string"


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the newest version; (0, None) where there is none."""
    try:
        newest = spark.read.schema(MANIFEST).json(f"{root}/manifest").agg(F.max(F.struct("version", "folder")).alias("v")).head()["v"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return (int(newest["version"]), newest["folder"]) if newest else (0, None)


def read_current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest version, or no rows."""
    _, folder = current(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{folder}") if folder else spark.createDataFrame([], schema)


def write_next(df: DataFrame, root: str) -> int:
    """Writes df as the next version, then its line in the manifest; if the first fails, readers go on with the old version."""
    version = current(df.sparkSession, root)[0] + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    df.sparkSession.createDataFrame([(version, folder)], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version
