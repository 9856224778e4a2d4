"""Stage tables for iterative plans: lineage ends at a written table that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on a local master without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _fallback.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="basalt-"))
    return at.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the staging folder and read it back."""
    path = f"{staging_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """The planner's size of what df reads and makes: that of its files, where it only reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of input, as the planner sees it, for one task of an operator whose memory would else grow with the table.
PART = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over as many partitions as its size asks for, where the session has fewer; a task then sorts a bounded part."""
    parts = min(100_000, -(-bytes_of(df) // PART))
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def filed_by(df: DataFrame, key: str) -> DataFrame:
    """Write df in buckets of a key under the staging folder; joins and groups on the key then do not move it. The table has no name in the catalog."""
    spark = df.sparkSession
    name, buckets = f"links_{uuid.uuid4().hex}", min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{staging_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
