"""Session set-up and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

# What a frame has shuffled goes when it is stored, not when the driver happens to collect its garbage.
STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# The JVM never compiles a generated method of more bytes; a wide projection that would need one runs without it.
WIDE = {**STORED, "spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app_name: str = "apptlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC makes calendar fields independent of the machine, ANSI turns silent
    overflow into an error, and adaptive execution picks join strategies from
    measured sizes and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder that all executors can reach.

    The folder is the one named in ``spark.checkpoint.dir``. Only a local
    session may do without it; there one machine runs everything.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="apptlens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for what is run inside, and the former ones after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, purpose: str, run: Mapping[str, str] = STORED) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where a frame feeds many later jobs (model fitting): lineage is cut,
    and losing an executor costs a re-read, not a recomputation. ``run`` holds
    session settings for the write.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    with settings(spark, run):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
