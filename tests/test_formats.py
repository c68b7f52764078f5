"""Sources and the dispatcher as Spark's own formats."""

import json

import pytest
from pyspark import TaskContext

from muster.errors import ConfigurationError
from muster.sinks.auth import auth_from
from muster.sinks.dispatch import Dispatcher, json_rows
from muster.sinks.writer import Sent, dispatch, dispatch_sink
from muster.sources import readers, sage, workday
from muster.sources.clients import PagesOf, PostsTo, Response, Retry

AUTH = {"tenant_url": "http://x", "tenant_id": "t", "username": "u", "password": "p"}


def pages(spark, folder, bodies):
    spark.createDataFrame([*enumerate(bodies, 1)], "page int, body string").write.mode("append").partitionBy("page").text(f"file://{folder}")
    return PagesOf(f"file://{folder}")


class Counted(PagesOf):
    """Notes each request in a folder."""

    def page(self, number):
        import os
        import uuid

        with open(f"{self.folder.removeprefix('file://')}-asked/{number}-{uuid.uuid4().hex}-{os.getpid()}", "w"):
            return super().page(number)


WORKERS = [
    "<r><wd:Total_Pages>3</wd:Total_Pages><wd:Worker><wd:WID> 7 </wd:WID><wd:First_Name>Ann<x/></wd:First_Name><bsvc:Email_Address>a@b</bsvc:Email_Address></wd:Worker></r>",
    "<r><bsvc:Worker><bsvc:Worker_ID>8</bsvc:Worker_ID><bsvc:First_Name>  </bsvc:First_Name><wd:Legal_First_Name>Bo</wd:Legal_First_Name></bsvc:Worker><wd:Worker><wd:Worker_ID></wd:Worker_ID><wd:WID>9</wd:WID></wd:Worker></r>",
    "<r/>",
]


def test_workers_by_a_reader(spark, tmp_path):
    """As the connector parses them; a partition for each page; a schema chooses columns."""
    client = pages(spark, tmp_path / "p", WORKERS)
    spark.dataSource.register(readers.worker_source(client))
    got = spark.read.format("muster_workers").options(**AUTH).load()
    want = workday.workers(spark.createDataFrame([(w,) for w in WORKERS], "body string"))
    assert got.columns == [*workday.COLUMNS] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.rdd.getNumPartitions() == 3
    some = spark.read.format("muster_workers").schema("first_name string, worker_id string").options(**AUTH).load()
    assert sorted(map(tuple, some.collect())) == [("", "9"), ("Ann", "7"), ("Bo", "8")]
    for schema, options in (("nope string", AUTH), ("worker_id int", AUTH), ("worker_id string", {"tenant_url": "x"})):
        with pytest.raises(Exception, match="column|option"):
            spark.read.format("muster_workers").schema(schema).options(**options).load().collect()


def employees_page(k, total, **more):
    return json.dumps({"data": [{"id": 10 * k + j, "first_name": f"n{j}", "post_code": [1, "x", None, {"a": 1}, True][j], "email": None} for j in range(5)], "meta": {"total_pages": total} | more})


def test_employees_by_a_stream_that_goes_on(spark, tmp_path):
    """A query that is started again fetches only new pages."""
    folder = tmp_path / "p"
    (tmp_path / "p-asked").mkdir()
    pages(spark, folder, [employees_page(k, 2) for k in (1, 2)])
    spark.dataSource.register(readers.employee_source(Counted(f"file://{folder}")))

    def drain():
        rows = spark.readStream.format("muster_employees").schema("id string, post_code string, email string").options(subdomain="x", api_token="t").load()
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        asked = [int(p.name.partition("-")[0]) for p in (tmp_path / "p-asked").iterdir()]
        for p in (tmp_path / "p-asked").iterdir():
            p.unlink()
        return sorted(asked)

    assert set(drain()) == {1, 2}
    want = sage.employees(spark.createDataFrame([(employees_page(k, 2),) for k in (1, 2)], "body string")).select("id", "post_code", "email")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
    spark.createDataFrame([(3, employees_page(3, 4)), (4, employees_page(4, 4))], "page int, body string").write.mode("append").partitionBy("page").text(f"file://{folder}")
    spark.createDataFrame([(1, employees_page(1, 4))], "page int, body string").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").text(f"file://{folder}")
    again = drain()
    assert set(again) == {1, 3, 4} and again.count(3) == again.count(4) == 1  # page 1 tells how many there are
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(str(10 * k + j) for k in (1, 2, 3, 4) for j in range(5))


def test_pages_that_nobody_counts(spark, tmp_path):
    body = lambda k, following: json.dumps({"data": [], "meta": {"next_page": following}})
    client = pages(spark, tmp_path / "p", [body(1, 2), body(2, 3), body(3, None)])
    reader = readers._EmployeeReader(client, sage.SageConfig("x", "t"), ["id"], False)
    assert reader.initialOffset() == {"page": 1} and reader.latestOffset() == {"page": 4}
    assert [p.number for p in reader.partitions({"page": 2}, {"page": 4})] == [2, 3]
    assert readers._EmployeeReader(client, sage.SageConfig("x", "t"), ["id"], True).latestOffset() == {"page": 3}


def test_dispatch_by_tasks(spark, tmp_path):
    dispatcher = Dispatcher(auth_from({"destination_url": "http://x", "token": "t"}), PostsTo(f"file://{tmp_path}/posts"), batch_rows=7)
    df = json_rows(spark.range(100).repartition(3))
    got = dispatch(df, dispatcher, f"file://{tmp_path}/report", "r1")
    bodies = [json.loads(p.read_text())["data"] for p in (tmp_path / "posts").iterdir()]
    assert sorted(x["id"] for b in bodies for x in b) == [*range(100)] and max(map(len, bodies)) == 7
    assert (got["rows"], got["batches"], got["refused"]) == (100, len(bodies), {})
    dispatch(df, dispatcher, f"file://{tmp_path}/report", "r1")  # the same run again: the endpoint keeps each batch once
    assert len([*(tmp_path / "posts").iterdir()]) == len(bodies)


class Refuses:
    def __call__(self, method, url, headers, body):
        return Response(422, "no") if b'"id":3' in body else Response(200, "")


def test_refused_batches_are_told(spark, tmp_path):
    dispatcher = Dispatcher(auth_from({"destination_url": "http://x", "token": "t"}), Refuses(), batch_rows=10)
    got = dispatch(json_rows(spark.range(0, 30, 1, 1)), dispatcher, f"file://{tmp_path}/report")
    assert got == {"rows": 20, "batches": 3, "refused": {"422": 1}, "answer": "no"}


def test_a_task_that_runs_again_counts_once(monkeypatch, tmp_path):
    """It fails in its third batch; its second attempt posts the same batches under the same keys, and only its count is in."""
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 5})()))
    fails, to = [1], PostsTo(f"file://{tmp_path}/posts")

    def transport(method, url, headers, body):
        if b'"c"' in body and fails:
            raise OSError(fails.pop())
        return to(method, url, headers, body)

    source = dispatch_sink(Dispatcher(auth_from({"destination_url": "http://x", "token": "t"}), transport, Retry(attempts=1, transport=False), batch_rows=1))
    writer = source({"run": "r", "report": f"file://{tmp_path}/report"}).writer(None, False)
    rows = [('{"x":"a"}',), ('{"x":"b"}',), ('{"x":"c"}',)]
    with pytest.raises(OSError):
        writer.write(iter(rows))
    told = writer.write(iter(rows))
    writer.commit([told, None, Sent(2, 1, {500: 1}, "x")])
    assert {p.name: json.loads(p.read_text())["data"][0]["x"] for p in (tmp_path / "posts").iterdir()} == {f"r-5-{k}.json": x for k, x in enumerate("abc")}
    assert json.loads((tmp_path / "report" / "sent.json").read_text()) == {"rows": 5, "batches": 4, "refused": {"500": 1}, "answer": "x"}
    assert ConfigurationError
