"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that go to a Python worker in one Arrow batch; bounds its memory when texts are long.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the session's Arrow batch size, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="veritrail-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one in local mode if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_local_dir()}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veritrail/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: its lineage ends there, so that a lost
    executor costs a reread only, and what follows may use it several times without computing it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df, marked for its next join to shuffle both sides. Spark sizes a table by its files: rows that were exploded, texts that compress well and
    columns with few values take many times that in the driver if they are broadcast."""
    return df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table whose rows nobody will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def row_hashes(rows: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns of a row. Nulls count (xxhash64 alone passes over them), and maps by their JSON."""
    parts = []
    for field in rows.schema.fields:
        value = F.col(f"`{field.name}`")
        if "map<" in field.dataType.simpleString() or field.dataType.typeName() == "variant":
            value = F.to_json(F.struct(value))
        parts += [value.isNull(), value]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts)]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5 (false for a null id, which counts as a training row)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
