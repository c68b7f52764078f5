"""Records of runs and settings: append-only Parquet events, of which the last of each key counts."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, ValidationError
from ..sinks.auth import DEFAULT, auth_from

RUN = "id string, organization_id string, customer_company_id string, status string, started_at timestamp, finished_at timestamp, rows_processed bigint, current_action string, error_message string, error_action_id string, error_row int, warnings array<struct<action_id:string,message:string,count:bigint,detail:string>>, validation_result string, manifest_snapshot string, at timestamp, n int"
CONFIG = "name string, image string, cron string, organizationId string, customerCompanyId string, lastEdited timestamp, pipeline string, deleted boolean, at timestamp, n int"
SETTINGS = "organizationId string, default_auth string, at timestamp, n int"
#: A run that has been running for longer no longer stands in the way of another.
STALE = timedelta(hours=12)
#: Turns before the last whose files are kept.
KEPT_TURNS = 20


def latest(events: DataFrame, *key: str) -> DataFrame:
    """The last event of each key; combines before the shuffle."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("at", "n")).alias("e"))
    return last.select(*key, "e.*").select(*[c for c in events.columns if c not in ("at", "n")])


def page(rows: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """Runs of a page, the newest first; pages count from 1, and hold 1 to 100 runs."""
    per_page, number = max(1, min(100, per_page)), max(1, number)
    return rows.orderBy(F.desc("started_at"), "id").offset((number - 1) * per_page).limit(per_page)


def last_page(total: int, per_page: int) -> int:
    return max(1, -(-total // max(1, per_page)))


def listed(rows: DataFrame, number: int = 1, per_page: int = 20) -> dict:
    """A page as a response: its runs, its number and size, and the number of the last page."""
    per_page, number = max(1, min(100, per_page)), max(1, number)
    data = [r.asDict(recursive=True) for r in page(rows, number, per_page).collect()]
    return {"data": data, "current_page": number, "count_per_page": per_page, "last_page": last_page(rows.count(), per_page)}


class Events:
    """Events of one schema in a folder; each append is a file of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def append(self, **values) -> None:
        self.n += 1
        names = self.spark.createDataFrame([], self.schema).columns
        row = {**dict.fromkeys(names), **values, "at": datetime.now(UTC), "n": self.n}
        self.spark.createDataFrame([tuple(row[n] for n in names)], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _there(self) -> bool:
        fs, path = self.at(self.path)
        return fs.exists(path)

    def at(self, path: str) -> tuple:
        """The file system that holds a path, and the path."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


class RunLog:
    def __init__(self, spark: SparkSession, path: str, organization: str, company: str) -> None:
        self.events, self.organization, self.company = Events(spark, path, RUN), organization, company
        self.open: dict[str, dict] = {}
        self.turns: dict[str, int] = {}

    def begin(self, manifest) -> str:
        """A new run, unless one of the company is running.

        Runs take turns, each of which is a file that the file system lets only one process make.  The last turn is open until
        its run adds an end to it or it is stale, and the next can be taken only then, so no file that another run may need is deleted."""
        last, is_open = self._last_turn()
        if is_open or self.active() or not self._made(f"{last + 1}"):
            raise ConflictError("a run is already in progress")
        if self._last_turn()[0] != last + 1:  # this process saw the turns before so late that others have come and gone
            raise ConflictError("a run is already in progress")
        run_id = str(uuid.uuid4())
        self.turns[run_id] = last + 1
        self.open[run_id] = {"id": run_id, "organization_id": self.organization, "customer_company_id": self.company, "started_at": datetime.now(UTC), "manifest_snapshot": manifest.to_json(), "warnings": []}
        self.events.append(**self.open[run_id], status="running")
        return run_id

    def validated(self, run_id: str, validation) -> None:
        self.open[run_id]["validation_result"] = json.dumps(asdict(validation))
        self.events.append(**self.open[run_id], status="running")

    def end(self, run_id: str, outcome) -> None:
        had = self.open.pop(run_id) | {"warnings": [(w.action_id, w.message, w.count, w.detail) for w in outcome.warnings]}
        self.events.append(**had, status=outcome.status, finished_at=datetime.now(UTC), rows_processed=outcome.rows, error_message=outcome.error, error_action_id=outcome.error_action)

        turn = self.turns.pop(run_id)
        self._made(f"{turn}.end")
        for old in (f"{turn - KEPT_TURNS}", f"{turn - KEPT_TURNS}.end"):
            fs, path = self._turn(old)
            fs.delete(path, False)

    def _last_turn(self) -> tuple[int, bool]:
        """Number of the last turn (0: none yet), and whether its run goes on."""
        fs, folder = self._turn()
        files = {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(folder)} if fs.exists(folder) else {}
        last = max((int(name) for name in files if name.isdigit()), default=0)
        since = (datetime.now(UTC) - STALE).timestamp() * 1000
        return last, last > 0 and f"{last}.end" not in files and files[f"{last}"] >= since

    def _made(self, name: str) -> bool:
        """Makes a file; False if there is one.  Hadoop's local file system looks first and then writes, so Python makes local ones."""
        fs, path = self._turn(name)
        if fs.getScheme() != "file":
            return fs.createNewFile(path)
        local = path.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            open(local, "x").close()
        except FileExistsError:
            return False
        return True

    def _turn(self, name: str = "") -> tuple:
        return self.events.at(f"{self.events.path}-turns/{self.organization}/{self.company}/{name}".rstrip("/"))

    def runs(self) -> DataFrame:
        mine = self.events.read().filter((F.col("organization_id") == self.organization) & (F.col("customer_company_id") == self.company))
        return latest(mine, "id")

    def count(self) -> int:
        return self.runs().count()

    def page(self, number: int = 1, per_page: int = 20) -> DataFrame:
        return page(self.runs(), number, per_page)

    def one(self, run_id: str) -> DataFrame:
        return self.runs().filter(F.col("id") == run_id).limit(1)

    def active(self) -> bool:
        since = datetime.now(UTC) - STALE
        return not self.runs().filter((F.col("status") == "running") & (F.col("started_at") > F.lit(since))).isEmpty()


class ConfigStore:
    """Pipelines of companies, and the default authentication of organisations."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.configs, self.settings = Events(spark, f"{base}/configs", CONFIG), Events(spark, f"{base}/settings", SETTINGS)

    def put(self, organization: str, company: str, name: str, cron: str, pipeline: str, image: str | None = None) -> None:
        if not cron.strip():
            raise ValidationError("cron must not be empty")
        self.configs.append(name=name, image=image, cron=cron, organizationId=organization, customerCompanyId=company, lastEdited=datetime.now(UTC), pipeline=pipeline, deleted=False)

    def delete(self, organization: str, company: str) -> None:
        self.configs.append(organizationId=organization, customerCompanyId=company, deleted=True)

    def of(self, organization: str) -> DataFrame:
        mine = self.configs.read().filter(F.col("organizationId") == organization)
        return latest(mine, "organizationId", "customerCompanyId").filter("not deleted").drop("deleted")

    def get(self, organization: str, company: str) -> DataFrame:
        return self.of(organization).filter(F.col("customerCompanyId") == company)

    def put_settings(self, organization: str, auth: dict) -> None:
        if auth_from(auth) == DEFAULT:
            raise ValidationError("the default auth cannot be 'default'")
        self.settings.append(organizationId=organization, default_auth=json.dumps(auth))

    def get_settings(self, organization: str) -> dict | None:
        found = latest(self.settings.read().filter(F.col("organizationId") == organization), "organizationId").collect()
        return json.loads(found[0]["default_auth"]) if found else None
