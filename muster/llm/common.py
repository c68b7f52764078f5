"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text for which a Python worker gathers results before it hands them on.
BATCH_BYTES = 2 << 20
#: Bytes of row places that may be broadcast.
MOST_BROADCAST = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='muster-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clear_scratch`` deletes what is there, at the end of the program at the latest."""
    if not _made:
        atexit.register(clear_scratch, spark)
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Delete one path that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch data of this program; call it when the results that were read from them are written."""
    try:
        for path in list(_made):
            discard(spark, path)
    except Exception:  # at the end of a program the session may be gone; the folder's owner then clears it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and a lost executor costs nothing."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the path, for ``discard``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now; it does so once the driver's objects are collected."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(col: str | Column = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce((F.col(f"`{col}`") if isinstance(col, str) else col).cast("string"), F.lit(""))


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return text_of(col).cast("binary")


def kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def map_texts(df: DataFrame, f: Callable[[list, list], dict[str, Iterable]], schema: str, text: str = "text", keep: str | Column = "doc_id") -> DataFrame:
    """Columns of ``f(kept values, UTF-8 bytes of the texts)`` for every row, for about ``BATCH_BYTES`` of texts at once.

    f returns the columns of the schema as lists or arrays of one value for each row."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                got = f(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.select((F.col(f"`{keep}`") if isinstance(keep, str) else keep).alias("k"), text_bytes(text).alias("t")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut after every ``most`` bytes, about, of its column ``text``."""
    ends = np.cumsum([len(x.as_buffer()) for x in batch.column(text)], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def located(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns, so none can clash) and ``at`` (file and number of the row in its Parquet file, which
    tell repeated rows apart).

    A DataFrame that is no plain Parquet read is written to the shared folder first."""
    try:
        return _at(docs)
    except AnalysisException:  # the plan has no files' metadata
        return _at(written(docs, "located"))


def _at(docs: DataFrame) -> DataFrame:
    file = docs.metadataColumn("_metadata")
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(file["file_path"].alias("file"), file["row_index"].alias("n")).alias("at"))
    found.schema  # plans it
    return found


def without(rows: DataFrame, drops: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The documents of located rows whose place is not in drops (column ``at``).

    drops is broadcast when its places take at most ``most`` bytes; else both sides shuffle, by place, so evenly."""
    size = drops.agg(F.coalesce(F.sum(F.octet_length("at.file") + 64), F.lit(0))).first()[0]
    drops = F.broadcast(drops) if size <= most else drops.hint("merge")
    return rows.join(drops, "at", "left_anti").select("row.*")


def coded(words: list, codes: defaultdict | None = None) -> np.ndarray:
    """The words as numbers in the order in which they first come up: equal numbers are equal words."""
    codes = defaultdict(count().__next__) if codes is None else codes
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
