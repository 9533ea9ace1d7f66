"""Appends that can be repeated: every batch of bookings has a key and is stored once.

A batch takes a range of ids by creating a file named after the range, which
succeeds for one writer only; writes its rows into a folder of that range; and
is stored from the moment its row is in the ledger. Readers follow the ledger:

* a batch sent again is found there and left out;
* rows of a writer that stopped before its ledger row are never read, and the
  batch, sent again, gets a new range;
* two writers that store the same batch at once both reach the ledger, and
  readers take the lower range.

Several writers may append at once. Exclusive creation holds on HDFS and local
file systems; on an object store without it, use one writer at a time.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptlens.operators.prefix import ROWS_PER_RANGE
from apptlens.schemas import APPOINTMENTS_SCHEMA
from apptlens.session import WIDE, settings
from apptlens.sources.appointments_table import complete_bookings

# Ids of a range: its number times this, and on.
IDS_PER_RANGE = 1 << 40
INITIAL = "initial"

_LEDGER = "batch string, n_rows long, last_id long, committed_at timestamp_ntz, range long"
_ROWS = T.StructType([*APPOINTMENTS_SCHEMA, T.StructField("range", T.LongType())])


def create_batches(spark: SparkSession, path: str, rows: DataFrame | None = None) -> None:
    """Start a table, from rows that have ids already (each once) or empty."""
    rows = spark.createDataFrame([], APPOINTMENTS_SCHEMA) if rows is None else rows
    with settings(spark, WIDE):
        rows.select(*APPOINTMENTS_SCHEMA.fieldNames()).write.parquet(f"{path}/rows/range=0")
    _commit(spark, path, INITIAL, 0)


def append_batch(spark: SparkSession, path: str, rows: DataFrame, batch: str, rows_per_range: int = ROWS_PER_RANGE) -> bool:
    """Store a batch of scored bookings unless it is stored already; whether it was new.

    The rows are read several times: store them first if they are dear to make.
    """
    ledger = read_ledger(spark, path)
    if not ledger.filter(F.col("batch") == batch).isEmpty():
        return False
    used = ledger.agg(F.max("last_id")).first()[0] or 0
    number = claim_range(spark, path, used // IDS_PER_RANGE + 1)
    full = complete_bookings(rows, F.lit(number * IDS_PER_RANGE), rows_per_range)
    with settings(spark, WIDE):
        full.write.parquet(f"{path}/rows/range={number}")
    _commit(spark, path, batch, number)
    return True


def claim_range(spark: SparkSession, path: str, first: int) -> int:
    """The number of a range, at least ``first``, that no other writer has or will get."""
    context = spark.sparkContext
    path_class = context._jvm.org.apache.hadoop.fs.Path
    folder = path_class(f"{path}/claims")
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)

    def create(name: str) -> bool:
        file = path_class(folder, name)
        if files.getUri().getScheme() == "file":
            # Hadoop looks first and creates then on local disks; Java does both at once.
            return context._jvm.java.io.File(file.toUri().getPath()).createNewFile()
        try:
            return files.createNewFile(file)
        except Py4JJavaError as error:
            # Another writer was first between the look and the creation.
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False

    number = max([first, *(int(s.getPath().getName()) + 1 for s in files.listStatus(folder))])
    while not create(str(number)):
        number += 1
    return number


def _commit(spark: SparkSession, path: str, batch: str, number: int) -> None:
    stored = spark.read.schema(APPOINTMENTS_SCHEMA).parquet(f"{path}/rows/range={number}")
    entry = stored.agg(F.count("*").alias("n_rows"), F.max("id").alias("last_id"))
    entry = entry.select(
        F.lit(batch).alias("batch"), "n_rows",
        F.coalesce("last_id", F.lit(number * IDS_PER_RANGE)).cast("long").alias("last_id"), F.current_timestamp().cast("timestamp_ntz").alias("committed_at"),
    )
    # A folder of its own: writers of one folder would clear each other's unfinished files.
    entry.write.parquet(f"{path}/ledger/range={number}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Stored batches, each once: its range, rows, highest id and time."""
    ledger = spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    rest = [c for c in ledger.columns if c not in ("batch", "range")]
    first = ledger.groupBy("batch").agg(F.min(F.struct("range", *rest)).alias("e"))
    return first.select("batch", "e.*")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of stored batches, with their ``batch``."""
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    return rows.join(read_ledger(spark, path).select("batch", "range"), "range").select(*APPOINTMENTS_SCHEMA.fieldNames(), "batch")
