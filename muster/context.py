"""What flows through a pipeline: one table, where its columns come from, and warnings."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Hidden column that keeps the order of rows; sinks and validation leave it out.
ROW_ID = "__row_id"
_numbers = itertools.count()


@dataclass
class FieldMetadata:
    source: str
    modified_by: str | None = None
    timestamp: str | None = None


@dataclass
class Warning_:
    action_id: str
    message: str
    count: int
    detail: str | None = None


class Warnings:
    """Collects warnings. Counts that depend on data are observed in the run's own jobs and read when it has ended."""

    def __init__(self) -> None:
        self.found: list[Warning_] = []
        self.pending: list[tuple[Observation, Callable[[dict], Warning_ | None]]] = []

    def add(self, w: Warning_) -> None:
        self.found.append(w)

    def observe(self, df: DataFrame, make: Callable[[dict], Warning_ | None], **counts: Column) -> DataFrame:
        """df with counts that are taken by the first job that reads all of it."""
        o = Observation(f"warnings-{next(_numbers)}")
        self.pending.append((o, make))
        return df.observe(o, *[c.alias(k) for k, c in counts.items()])

    def drain(self, ran: bool = True) -> list[Warning_]:
        """All warnings so far; with ran=False, those that wait for data are dropped."""
        pending, self.pending = self.pending, []
        if ran:
            self.found += [w for o, make in pending if (w := make(o.get))]
        out, self.found = self.found, []
        return out


@dataclass
class RosterContext:
    data: DataFrame
    metadata: dict[str, FieldMetadata] = field(default_factory=dict)
    warnings: Warnings = field(default_factory=Warnings)
    #: Tables that sinks keep so that their sources are read once; ``release`` lets go of them.
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self) -> RosterContext:
        self.kept.append(self.data.persist())
        return self.with_data(self.kept[-1])

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c != ROW_ID]

    def with_data(self, data: DataFrame) -> RosterContext:
        return replace(self, data=data)

    def came_from(self, names: list[str] | tuple[str, ...], source: str, modified_by: str | None = None) -> RosterContext:
        """Names get a new entry, which clears an earlier one."""
        return replace(self, metadata=self.metadata | {n: FieldMetadata(source, modified_by) for n in names})

    def modified(self, names: list[str] | tuple[str, ...], by: str) -> RosterContext:
        """Names without an entry stay without."""
        return replace(self, metadata=self.metadata | {n: replace(self.metadata[n], modified_by=by) for n in names if n in self.metadata})


def quoted(name: str) -> Column:
    """A column by its exact name, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in itertools.count() if (n := f"__{name}{k or ''}") not in taken)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share: ``spark.checkpoint.dir``, or one of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='muster-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def numbered(df: DataFrame) -> DataFrame:
    """df with ROW_ID in the order of its partitions."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def visible(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def in_order(df: DataFrame) -> DataFrame:
    """The visible columns in the order of rows, if it is known."""
    return visible(df.orderBy(ROW_ID) if ROW_ID in df.columns else df)
