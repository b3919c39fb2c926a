"""Session defaults shared by the entry points, the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "parlance", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller's own session is used instead.

    AQE stays on, so that shuffle partitions are coalesced or split from run-time sizes.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a table below which dealing its rows out costs next to nothing.
SMALL_TABLE = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, by any path that Spark's readers open.

    A scan splits files by row groups, so a small table of one file is one task however many cores there are. A table of fewer files than cores and of less than
    SMALL_TABLE bytes is dealt out to all cores; others, any large one among them, are read where they lie.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and 1 << 16 < df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_TABLE:
        return df.repartition(2 * cores)
    return df
