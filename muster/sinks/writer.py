"""The dispatcher as a format of Spark's own writer: tasks post batches, and no row goes through the driver.

    spark.dataSource.register(dispatch_sink(Dispatcher(auth)))
    json_rows(df).write.format("muster_dispatch").mode("append").options(run="2024-05", report="file:///shared/sent").save()

Every request carries an ``Idempotency-Key`` of the run, the task and the batch, so an endpoint that honours it takes the batches
of a task that runs again once.  Each task tells how many rows it has sent and what it was answered; only the
tasks that count, one for each partition, are in the report, a JSON file that the writer's end puts into the folder ``report``.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import EgressError
from ..sources.clients import by_value


@dataclass
class Sent(WriterCommitMessage):
    rows: int
    batches: int
    #: Batches by the status of an answer that refused them, and the first such answer.
    refused: dict[int, int]
    answer: str


def dispatch_sink(dispatcher) -> type[DataSource]:
    """Format ``muster_dispatch``, for one column of JSON objects.  The dispatcher goes to the tasks with its transport."""
    by_value(dispatcher.transport)

    class Dispatch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "muster_dispatch"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(dispatcher, self.options.get("run") or uuid.uuid4().hex, self.options.get("report"))

    return Dispatch


class _Writer(DataSourceWriter):
    def __init__(self, dispatcher, run: str, report: str | None) -> None:
        self.dispatcher, self.run, self.report = dispatcher, run, report

    def write(self, iterator: Iterator) -> Sent:
        part, batch, held, sent, refused, answer = TaskContext.get().partitionId(), 0, [], 0, Counter(), ""

        def post() -> None:
            nonlocal batch, held, sent, answer
            own = replace(self.dispatcher, headers=(*self.dispatcher.headers, ("Idempotency-Key", f"{self.run}-{part}-{batch}")))
            got = own.post(held)
            if got.status >= 400:
                refused[got.status] += 1
                answer = answer or got.body[:200]
            else:
                sent += len(held)
            batch, held = batch + 1, []

        for row in iterator:
            held.append(row[0])
            if self.dispatcher.batch_rows and len(held) >= self.dispatcher.batch_rows:
                post()
        if held:
            post()
        return Sent(sent, batch, dict(refused), answer)

    def commit(self, messages: list[Sent | None]) -> None:
        if self.report is None:
            return
        told, refused = [m for m in messages if m is not None], Counter()
        for m in told:
            refused.update(m.refused)
        total = {"rows": sum(m.rows for m in told), "batches": sum(m.batches for m in told), "refused": {str(k): n for k, n in refused.items()}, "answer": next((m.answer for m in told if m.answer), "")}
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.report)
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/sent.json") as f:
            f.write(json.dumps(total).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        pass


def dispatch(json_rows: DataFrame, dispatcher, report: str, run: str | None = None) -> dict:
    """Send a column of JSON objects by tasks; returns the report: rows and batches sent, and refused batches by status."""
    spark = json_rows.sparkSession
    spark.dataSource.register(dispatch_sink(dispatcher))
    try:
        json_rows.write.format("muster_dispatch").mode("append").options(run=run or uuid.uuid4().hex, report=report).save()
    except Exception as e:
        raise EgressError(str(e).splitlines()[0]) from e
    fs, folder = pyarrow.fs.FileSystem.from_uri(report)
    with fs.open_input_stream(f"{folder}/sent.json") as f:
        return json.loads(f.read())
