"""CSV files of an organisation's company; every column is a string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..context import ROW_ID, RosterContext, numbered, quoted
from ..errors import ConfigurationError, IngestionError

CORRUPT = "__corrupt"


def checked_filename(name: str) -> str:
    name = name.strip()
    if not name or any(x in name for x in ("/", "\\", "..")):
        raise ConfigurationError(f"filename is not usable: {name!r}")
    return name


def stem(name: str) -> str:
    """The text before the last dot; a name that begins with its only dot is kept whole."""
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name


@dataclass(frozen=True)
class Location:
    """Where a company's files lie."""

    base: str
    organization: str
    company: str

    def source(self, filename: str) -> str:
        return f"{self.base}/{self.organization}/{self.company}/{stem(checked_filename(filename))}.csv"

    def output(self, action_id: str) -> str:
        return f"{self.base}/{self.organization}/{self.company}/outputs/{action_id}.csv"


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line, as Spark's reader splits it."""
    first = spark.read.option("header", False).option("quote", '"').option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise IngestionError(f"{path} is empty")
    return [(c or "").strip() for c in first[0]]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where a task's part of the file begins), line, and the number of quotes in it; Spark splits files at line
    feeds, also at those in cells."""
    rows = spark.read.option("lineSep", "\n").text(path)
    where = rows.metadataColumn("_metadata")
    rows = rows.select(where["file_path"].alias("file"), where["file_block_start"].alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files (column ``record``) with their order (``number``, of the first line), whatever line feeds
    their cells hold, read by as many tasks as the files have blocks.

    A line begins a record if the quotes before it in its file are even in number.  Blocks count their quotes and lines, and sums over
    the blocks before tell each its parity; within a block running sums do.  Lines that are a record of their own stay
    where they are; only the pieces of others are brought together, by their record's first line."""
    in_block = Window.partitionBy("file", "block").orderBy("at")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    lines = _lines(spark, path).withColumns({"k": F.row_number().over(in_block) - 1, "parity": parity})
    # For either parity of what is before the block: its last line that begins a record.
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.count("*").alias("n"), *[F.max(F.when(F.col("parity") == p, F.col("k"))).alias(f"last{p}") for p in (0, 1)])
    of_file, all_ = Window.partitionBy("file").orderBy("block"), Window.orderBy("file", "block")  # a row for each block
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "last0", "last1", (earlier("q", of_file) % 2).alias("odd"), earlier("n", all_).alias("base"))
    last = F.col("base") + F.when(F.col("odd") == 0, F.col("last0")).otherwise(F.col("last1"))
    blocks = blocks.select("file", "block", "odd", "base", F.max(last).over(of_file.rowsBetween(Window.unboundedPreceding, -1)).alias("open"), (F.row_number().over(of_file) == 1).alias("first"))
    rows = lines.join(blocks, ["file", "block"])
    number, begins = F.col("base") + F.col("k"), F.col("parity") == F.col("odd")
    rows = rows.select("line", "quotes", number.alias("number"), begins.alias("begins"), (F.col("first") & (F.col("k") == 0)).alias("header"),
                       F.coalesce(F.last(F.when(begins, number), True).over(in_block), F.col("open")).alias("record_no"))
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    pieces = rows.filter(~whole).groupBy("record_no").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("lines"), F.bool_or("header").alias("header"))
    pieces = pieces.select(F.col("record_no").alias("number"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"), "header")
    both = rows.filter(whole).select("number", F.col("line").alias("record"), "header").unionByName(pieces)
    text = F.regexp_replace("record", "\r$", "")
    return both.filter(~F.col("header") & (text != "")).select(text.alias("record"), "number")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, many_lines: bool = True) -> DataFrame:
    """All columns as strings, with their order of rows.

    Rows with fewer cells than the header get nulls; rows with more are an error, as they hold data that has no name.
    Cells may hold line feeds; a cell with quotes has to be quoted.  Files are split among tasks: where some line has an odd number
    of quotes, records are put together by ``records``, else each line is one, as with many_lines=False, which doesn't look."""
    names = header(spark, path)
    if len(set(names)) != len(names):
        raise ConfigurationError(f"{path} has repeated column names: {', '.join(names)}")
    if columns is not None and len(columns) != len(names):
        raise ConfigurationError(f"columns has {len(columns)} names but {path} has {len(names)} columns")
    schema = StructType([StructField(n, StringType()) for n in [*(columns or names), CORRUPT]])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    many_lines = many_lines and not _lines(spark, path).filter("quotes % 2 = 1").isEmpty()
    if many_lines:
        ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
        rows = records(spark, path).select(F.from_csv("record", ddl, options | {"multiLine": "true"}).alias("r"), F.col("number").alias(ROW_ID)).select("r.*", ROW_ID)
    else:
        rows = spark.read.options(header=True, enforceSchema=True, **options).schema(schema).csv(path)
    kept = [quoted(n) for n in schema.names[:-1]]
    # A record is marked corrupt for too few cells as well as for too many; only the latter has more separators than the header.
    extra = F.size(F.split(F.regexp_replace(quoted(CORRUPT), '"(?:[^"]|"")*"', ""), ",")) > len(names)
    stop = F.raise_error(F.concat(F.lit("a row has more cells than the header: "), quoted(CORRUPT))).cast("string")
    guard = F.when(quoted(CORRUPT).isNotNull() & extra, stop).otherwise(kept[0])
    own = rows.select(guard.alias(schema.names[0]), *kept[1:], *([ROW_ID] if many_lines else []))
    return own if many_lines else numbered(own)


def generic_ingestion(spark: SparkSession, location: Location | None, filename: str, columns: list[str] | None = None, many_lines: bool = True) -> RosterContext:
    checked_filename(filename)
    if location is None:
        raise ConfigurationError("the file's key has not been resolved")
    ctx = RosterContext(read_csv(spark, location.source(filename), columns, many_lines))
    return ctx.came_from(ctx.columns, "GENERIC_INGESTION")


def empty(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
