"""Shared helpers: Arrow passes over text and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tablelens.session import conf_override

#: Bytes of text that one call of a text function gets at most (one row at least).
PIECE_BYTES = 1 << 20
#: Bytes of rows that an Arrow batch between Spark and Python holds at most (one row at least), where a table is stored.
BATCH_BYTES = 1 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parquet ends a page or row group by its bytes from the first row on, not from the hundredth: rows can be a MB each.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of the column; a longer row is alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, rows = 0, batch.num_rows
    while at < rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_text(
    df: DataFrame,
    text: str,
    outputs: StructType,
    make: Callable[[], Callable[[pa.Array], Sequence]],
    carry: Sequence = ("doc_id",),
    limit: int = PIECE_BYTES,
    keep: str | None = None,
) -> DataFrame:
    """The carried columns and, computed from the text column, the output columns.

    ``make`` runs once in each task and returns the function that turns a text
    array (nulls included) into one sequence or array for each output column.
    No other column is read, so extra columns cannot clash.  With ``keep`` the
    text itself is returned too, under that name, before the output columns.
    """
    chosen = df.select(*[F.col(c) if isinstance(c, str) else c for c in carry], F.col(text).cast("string").alias("__text"))
    kept = [*chosen.schema.fields[:-1], *([StructField(keep, StringType())] if keep else [])]
    kinds = [f.type for f in to_arrow_schema(outputs)]
    names = [f.name for f in kept] + outputs.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        work = make()
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, limit):
                made = work(part.column(part.num_columns - 1))
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=k) for a, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], names=names)

    return chosen.mapInArrow(run, StructType([*kept, *outputs.fields]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a private one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    with conf_override(spark, ARROW_BYTES, str(BATCH_BYTES)):
        df.write.options(**PAGES).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, for frames that the caller runs.

    Spark reads the setting when a frame runs, so it must outlast the call that makes the frame.
    Otherwise a batch holds 10,000 rows, however long, in each task; executors keep the memory of the largest.
    """
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once all that is made of them is stored itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: The column that tells the rows of a table apart.
ROW = "__row_of_table"


def with_rows(df: DataFrame) -> DataFrame:
    """The table with a column ``ROW``: the digest of the row's file and the row's place in it.

    It is the same in every pass, on any executor and however files are split.  A frame
    that is no table as read is stored first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = stored(df)
    meta = df.metadataColumn("_metadata")
    return df.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")).alias(ROW))


#: Keys that a filter broadcasts at most; beyond it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ``keys``, less the column ``ROW``. Few keys are broadcast, so the rows need no shuffle."""
    some = stored(keys.select(key).distinct())
    left = df.join(F.broadcast(some) if some.count() <= BROADCAST_KEYS else some, key, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in df.columns if c != ROW])


def release() -> None:
    """Give back to the system what earlier tasks of this Python worker have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Rows of consecutive values; ``ends`` has the end of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
