"""Helpers that several training-data operators share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at once.
CHUNK_ROWS = 512

#: Entries that a per-task memo holds before it is emptied.
MEMO_ENTRIES = 300_000

#: Longer words are computed each time instead of being remembered.
MEMO_WORD_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The copy cuts the lineage, so a lost executor costs only the reading, and
    what was drawn or numbered in ``df`` cannot change between two readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._fl_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, as soon as no later job reads it."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._fl_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of the given rows, which the driver holds; a literal in the plan."""
    entries = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return spark.range(1).select(F.inline(entries))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Memo(dict):
    """A bounded cache of a function of one byte string."""

    def __init__(self, function: Callable[[bytes], object], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, word: bytes):
        value = self.function(word)
        if len(word) <= MEMO_WORD_BYTES:
            if len(self) >= self.entries:
                self.clear()
            self[word] = value
        return value
