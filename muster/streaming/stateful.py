"""Steps that look at other rows, over streams: identities and history.  Their state lies on disk (RocksDB) by key and never
expires, so a stream goes on from its checkpoint where it was.

``STATE`` are the settings that a session needs while such a query starts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DecimalType, IntegralType, LongType, StringType, StructField, StructType

from ..context import fresh, quoted
from ..errors import LogicError

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _exact(schema: StructType) -> StructType:
    """Whole numbers as decimals: pandas would make nullable ones floating."""
    return StructType([StructField(f.name, DecimalType(20, 0) if isinstance(f.dataType, IntegralType) else f.dataType) for f in schema])


def _as(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[quoted(f.name).cast(f.dataType) if df.schema[f.name].dataType != f.dataType else quoted(f.name) for f in schema])


class _First(StatefulProcessor):
    """Retains the identifier of the first row of each key."""

    def __init__(self, id_column: str, order_column: str | None) -> None:
        self.id_column, self.order_column = id_column, order_column

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("id", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.first.get() if self.first.exists() else None
        if found is None:  # the first row may be in any of the batch's parts
            whole = pd.concat(rows, ignore_index=True)
            at = whole[self.order_column].argmin() if self.order_column else 0
            first = whole[self.id_column].iloc[at]
            first = "unknown" if first is None else str(first)
            self.first.update((first,))
            yield whole.assign(canonical_id=first, is_duplicate=[k != at for k in range(len(whole))])
        else:
            for part in rows:
                yield part.assign(canonical_id=found[0], is_duplicate=True)

    def close(self) -> None:
        pass


def identities(rows: DataFrame, columns: list[str], id_column: str = "employee_id", order_column: str | None = None) -> DataFrame:
    """A stream with canonical_id (of the first row with the same key in the earliest micro-batch that has one) and
    is_duplicate.  The key is the first of the columns that isn't null; rows without one are their own and keep no state.

    Within a micro-batch rows come by ``order_column``, else as they are."""
    if missing := [c for c in (*columns, id_column, *([order_column] if order_column else [])) if c not in rows.columns]:
        raise LogicError(f"identity_deduplicator: column(s) not found: {', '.join(missing)}")
    rows, key = rows.drop(*[c for c in ("canonical_id", "is_duplicate") if c not in columns]), fresh(rows, "key")
    added = [StructField("canonical_id", StringType()), StructField("is_duplicate", BooleanType())]
    keyed = rows.withColumn(key, F.coalesce(*[quoted(c).cast("string") for c in columns]))
    schema = StructType([*_exact(rows.schema), *added])
    marked = _as(keyed.filter(F.col(key).isNotNull()), _exact(keyed.schema)).groupBy(key).transformWithStateInPandas(_First(id_column, order_column), schema, "append", "none")
    own = keyed.filter(F.col(key).isNull()).withColumns({"canonical_id": F.coalesce(quoted(id_column).cast("string"), F.lit("unknown")), "is_duplicate": F.lit(False)})
    return _as(marked, StructType([*rows.schema, *added])).unionByName(own.drop(key))


class _History(StatefulProcessor):
    """Retains the dates and ties of each entity's rows, in order; how many there are is the version."""

    def __init__(self, key: StructType, date_column: str, ties: list[str]) -> None:
        self.key, self.names = key, [date_column, *ties]

    def init(self, handle) -> None:
        self.kept = handle.getListState("keys", self.key)

    @staticmethod
    def order(row: tuple) -> tuple:
        """Nulls come first."""
        return tuple((x is not None, 0 if x is None else x) for x in row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda row: tuple(None if x is None or x is pd.NaT or x != x else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)
        had = [plain(r) for r in self.kept.get()]
        new = [plain(r) for part in rows for r in zip(*[part[c].tolist() for c in self.names])]
        merged = sorted([*had, *new], key=self.order)
        version = len(merged)
        # What a new row says of itself, and what it changes in the row before it.
        touched, orders = set(), [self.order(r) for r in merged]
        for r in new:
            at = bisect_left(orders, self.order(r))
            touched |= {at - 1, at}
            while at + 1 < len(merged) and orders[at + 1] == orders[at]:  # rows that are repeated
                at += 1
                touched.add(at)
        self.kept.put(merged)
        at = sorted(k for k in touched if k >= 0)
        columns = {c: pd.Series([merged[k][j] for k in at], dtype=object) for j, c in enumerate(self.names)}
        to = [merged[k + 1][0] if k + 1 < len(merged) else None for k in at]
        yield pd.DataFrame({"entity": [key[0]] * len(at), **columns, "effective_to": pd.Series(to, dtype=object), "is_current": [x is None for x in to], "version": version})

    def close(self) -> None:
        pass


def history(rows: DataFrame, entity_column: str = "employee_id", date_column: str = "start_date", tie_break: list[str] | None = None) -> DataFrame:
    """A stream of changes of an effective-dated history: for each new row, and for each earlier row that a new one closes
    or cuts short, the entity, effective_from, the ties, effective_to and is_current, with a version that grows with the changes of an
    entity.  Rows may come in any order and however late; the ties (at least one column) tell an entity's rows of a date apart.

    An entity's keys are read and written when one of its rows comes."""
    ties = tie_break or []
    if missing := [c for c in (entity_column, date_column, *ties) if c not in rows.columns]:
        raise LogicError(f"scd_type_2: column(s) not found: {', '.join(missing)}")
    if not ties:
        raise LogicError("scd_type_2: a stream needs columns that tell rows of a date apart")
    rows = rows.select(quoted(entity_column).alias("entity"), quoted(date_column), *[quoted(c) for c in ties])
    plain, rows = rows.schema, _as(rows, _exact(rows.schema))
    key = StructType(rows.schema.fields[1:])
    schema = StructType([rows.schema["entity"], *key.fields, StructField("effective_to", key[0].dataType), StructField("is_current", BooleanType()), StructField("version", LongType())])
    got = rows.groupBy("entity").transformWithStateInPandas(_History(key, date_column, ties), schema, "append", "none")
    got = _as(got, StructType([*plain, StructField("effective_to", plain[1].dataType), *schema[-2:]]))
    return got.withColumnsRenamed({"entity": entity_column, date_column: "effective_from"})


def latest(changes: DataFrame, entity_column: str, tie_break: list[str]) -> DataFrame:
    """The history after all these changes: the last version of each row."""
    keys = [entity_column, "effective_from", *tie_break]
    last = F.max(F.struct("version", "effective_to", "is_current")).alias("last")
    return changes.groupBy(*[quoted(k) for k in keys]).agg(last).select(*[quoted(k) for k in keys], "last.effective_to", "last.is_current")
