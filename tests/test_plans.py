import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from muster.context import visible
from muster.errors import ConfigurationError, ConflictError, LogicError, StepError, ValidationError
from muster.plans import run_log
from muster.plans.manifest import REGISTRY, Environment, Manifest
from muster.plans.run_log import ConfigStore, RunLog, last_page, listed
from muster.plans.runner import Outcome, run, run_steps, validate, validate_pipeline
from muster.sources.csv import Location
from muster.sources.clients import Response
from muster.streaming import stateful
from muster.streaming.micro import stream

#: Moorings of a harbour: what the boats' owners have told, one row a visit.
COLUMNS = ["visit", "boat", "skipper", "harbour_country", "call_sign", "berth_fee", "arrival", "radio"]
FINAL = ["visit", "vessel", "skipper", "berth_fee", "effective_from", "radio", "flag", "canonical_id", "is_duplicate", "skipper_plain", "effective_to", "is_current"]


def manifest(*steps):
    return Manifest.parse({"version": "1.0", "actions": [{"id": f"s{k}", "action_type": t, "config": c} for k, (t, c) in enumerate(steps)]})


FULL = (
    ("generic_ingestion_connector", {"filename": "visits.csv", "columns": COLUMNS}),
    ("iso_country_sanitizer", {"source_column": "harbour_country", "output_column": "flag", "output_format": "alpha3"}),
    ("filter_by_value", {"column": "call_sign", "pattern": "^(?:QX|QY)"}),
    ("identity_deduplicator", {"columns": ["call_sign"], "employee_id_column": "visit"}),
    ("handle_diacritics", {"columns": ["skipper"], "output_suffix": "_plain"}),
    ("scd_type_2", {"entity_column": "boat", "date_column": "arrival", "tie_break": ["visit"]}),
    ("pii_masking", {"columns": [{"name": "skipper", "keep_last": 2, "mask_prefix": "~"}, {"name": "berth_fee", "strategy": "zero"}]}),
    ("cellphone_sanitizer", {"phone_column": "radio", "country_columns": ["flag"], "output_column": "radio"}),
    ("regex_replace", {"column": "boat", "pattern": "[aeiou]+$", "replacement": "!"}),
    ("drop_column", {"columns": ["call_sign", "harbour_country"]}),
    ("rename_column", {"mapping": {"boat": "vessel"}}),
)


@pytest.fixture
def env(spark, tmp_path):
    """120 visits of 8 boats; every sixth has a call sign of another harbour, every tenth a country that isn't known."""
    where = Location(str(tmp_path), "org", "co")
    boats, signs = ("Albatros", "Bora", "Calypso", "Dune", "Etoile", "Fado", "Gota", "Halo"), ("QX", "QY", "QX", "QY", "QX", "ZZ")
    lines = [",".join(COLUMNS)]
    for k in range(120):
        country = "Lemuria" if k % 10 == 9 else ("Portugal", "nld", "GB")[k % 3]
        lines.append(f"{k},{boats[k % 8]},Zoë Ångström {k % 8},{country},{signs[k % 6]}-{k % 40},{k}.50,2023-{k % 9 + 1:02}-{k % 28 + 1:02},0{k:03}-555 12")
    folder = tmp_path / "org" / "co"
    folder.mkdir(parents=True)
    (folder / "visits.csv").write_text("\n".join(lines) + "\n")
    return Environment(spark, where)


def test_full_run(env, spark, tmp_path):
    m = manifest(*FULL)
    assert validate(m, env).final_columns == FINAL
    log = RunLog(spark, str(tmp_path / "runs"), "org", "co")
    got = run(m, env, log)
    assert (got.status, got.rows, got.columns) == ("success", 100, FINAL)
    unknown = sum(k % 10 == 9 for k in range(120))
    assert {(w.action_id, w.count) for w in got.warnings} == {("iso_country_sanitizer", unknown), ("filter_by_value", 20), ("cellphone_sanitizer", sum(k % 10 == 9 and k % 6 != 5 for k in range(120)))}
    df = visible(run_steps(m, env).data)
    r = df.filter("visit = '1'").first()
    assert (r.vessel, r.skipper, r.skipper_plain, r.berth_fee, r.flag, r.radio) == ("Bor!", "~ 1", "Zoe Angstrom 1", 0, "NLD", "+31 00155512")
    kept = [k for k in range(120) if k % 6 != 5]
    first = {}
    for k in kept:
        first.setdefault((k % 6 in (1, 3), k % 40), k)
    assert {r.visit: (r.canonical_id, r.is_duplicate) for r in df.collect()} == {str(k): (str(first[k % 6 in (1, 3), k % 40]), first[k % 6 in (1, 3), k % 40] != k) for k in kept}
    assert df.filter("is_current").count() == 8
    (row,) = log.page().collect()
    assert row.status == "success" and row.rows_processed == 100 and len(row.warnings) == 3 and json.loads(row.manifest_snapshot)["version"] == "1.0"
    assert log.count() == 1 and log.one(row.id).count() == 1 and not log.active()


def test_tables_that_sinks_keep_are_let_go(env, spark):
    run(manifest(*FULL, ("show_data", {})), env)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_two_runs_cannot_begin_at_once(spark, tmp_path):
    """The turn of a run that another process has just begun stands in the way before its first record is there."""
    log, other = (RunLog(spark, str(tmp_path / "runs"), "org", "co") for _ in range(2))
    assert other._made("1")
    with pytest.raises(ConflictError):
        log.begin(manifest())
    fs, turn = other._turn("1")
    fs.setTimes(turn, 1000, 1000)  # a stale turn is passed over
    run_id = log.begin(manifest())
    log.end(run_id, Outcome("success", 1, []))
    assert log._last_turn() == (2, False) and log.begin(manifest()) and log._last_turn() == (3, True)


def test_one_of_many_replaces_a_stale_run(spark, tmp_path):
    logs = [RunLog(spark, str(tmp_path / "runs"), "org", "co") for _ in range(6)]
    assert logs[0]._made("1")
    fs, turn = logs[0]._turn("1")
    fs.setTimes(turn, 1000, 1000)

    def begin(log):
        try:
            return log.begin(manifest())
        except ConflictError:
            return None

    with ThreadPoolExecutor(len(logs)) as pool:
        begun = list(pool.map(begin, logs))
    assert sum(x is not None for x in begun) == 1 and logs[0].count() == 1


def test_a_late_process_does_not_begin(spark, tmp_path, monkeypatch):
    """It has seen turns that are long gone, whose files are no longer there."""
    monkeypatch.setattr(run_log, "KEPT_TURNS", 2)
    log, late = (RunLog(spark, str(tmp_path / "runs"), "org", "co") for _ in range(2))
    for _ in range(5):
        log.end(log.begin(manifest()), Outcome("success", 1, []))
    seen = iter([(1, False)])
    monkeypatch.setattr(late, "_last_turn", lambda: next(seen, None) or log._last_turn())
    with pytest.raises(ConflictError):
        late.begin(manifest())
    assert log.begin(manifest())


def test_pages_of_runs(spark):
    rows = spark.range(5).selectExpr("cast(id as string) AS id", "timestamp_seconds(id) AS started_at")
    got = listed(rows, 2, 2)
    assert [r["id"] for r in got.pop("data")] == ["2", "1"] and got == {"current_page": 2, "count_per_page": 2, "last_page": 3}
    assert listed(rows.limit(0))["last_page"] == 1 and listed(rows, 0, 1000)["count_per_page"] == 100


def test_failures_close_the_record(env, spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"), "org", "co")
    bad = run(manifest(FULL[0], ("drop_column", {"columns": ["nope"]})), env, log)
    assert bad.status == "validation_failed" and bad.error_action == "s1"
    late = run(manifest(FULL[0], ("filter_by_value", {"column": "nope", "pattern": "x"})), env, log)
    assert late.status == "failed" and late.error_action == "filter_by_value"
    assert {r.status for r in log.runs().collect()} == {"validation_failed", "failed"}
    log.begin(manifest())
    with pytest.raises(ConflictError):
        log.begin(manifest())


def test_manifests(spark):
    m = manifest(("drop_column", {"columns": ["a"]}))
    assert Manifest.parse(m.to_json()) == m
    assert Manifest.parse('{"version":"1","actions":[{"id":"a","action_type":"pii_masking"}]}').actions[0].config == {}
    assert len(REGISTRY) == 15
    for bad in ("{", '{"version":"1"}', '{"version":"1","actions":[{"id":"a","action_type":"x"}]}', '{"version":"1","actions":[{"id":"a","action_type":"scd_type_2","config":[]}]}'):
        with pytest.raises(ConfigurationError):
            Manifest.parse(bad)


def test_validation(env):
    assert validate(manifest(), env).final_columns == []
    bearer = ("api_dispatcher", {"auth_type": "bearer", "destination_url": "u", "schema": {"a": "string"}})
    source = ("generic_ingestion_connector", {"filename": "x.csv", "columns": ["a", "b"]})
    assert validate_pipeline(manifest(source, bearer), env).final_columns == ["a", "b"]
    cases = [
        ((), "needs steps"),
        ((source,), "the last step must be a sink .*, not 'generic_ingestion_connector'"),
        ((source, ("drop_column", {"columns": ["a"]}), bearer), "the last step does not have: a"),
        ((source, ("api_dispatcher", {"auth_type": "default"})), "no default auth"),
        ((source, ("drop_column", {"columns": ["z"]}), bearer), "drop_column 's1' fails"),
    ]
    for steps, message in cases:
        with pytest.raises(ValidationError, match=message):
            validate_pipeline(manifest(*steps), env)
    assert validate_pipeline(manifest(source, ("show_data", {})), env).final_columns == ["a", "b"]
    own = Environment(env.spark, env.location, {"auth_type": "bearer", "destination_url": "u", "schema": {"q": "string"}})
    with pytest.raises(ValidationError, match="does not have: q"):
        validate_pipeline(manifest(source, ("api_dispatcher", {"auth_type": "default"})), own)
    assert validate(manifest(source, ("scd_type_2", {"entity_column": "a", "date_column": "b"})), env).final_columns == ["a", "effective_from", "effective_to", "is_current"]
    with pytest.raises(StepError):
        validate(manifest(("generic_ingestion_connector", {"filename": "../x"})), env)


def test_sinks_in_a_run(env, spark):
    seen = []
    env.clients["http"] = lambda method, url, headers, body: seen.append(body) or Response(200, "")
    steps = (*FULL, ("show_data", {}), ("api_dispatcher", {"destination_url": "http://x"}))
    got = run(manifest(*steps), env)
    assert got.status == "success" and len(json.loads(seen[0])["data"]) == 100
    assert spark.read.option("header", True).csv(env.location.output("s11")).columns == FINAL


def test_dedup_after_history_goes_by_the_sorted_order(env):
    steps = (FULL[0], ("scd_type_2", {"entity_column": "harbour_country", "date_column": "arrival"}), ("identity_deduplicator", {"columns": ["effective_from"], "employee_id_column": "visit"}), ("show_data", {}))
    got = visible(run_steps(manifest(*steps), env).data).collect()
    first = {}
    for r in sorted(got, key=lambda r: (r.harbour_country, r.effective_from, int(r.visit))):
        assert r.is_duplicate == (r.effective_from in first) and r.canonical_id == first.setdefault(r.effective_from, r.visit)
    shown = [(r.harbour_country, r.effective_from) for r in env.spark.read.option("header", True).csv(env.location.output("s3")).collect()]
    assert shown == sorted(shown) and len(shown) == 120


def test_command_line(env, spark, tmp_path, capsys):
    from muster.__main__ import main
    from muster.plans.schemas import SCHEMAS, action_schema

    (tmp_path / "m.json").write_text(manifest(*FULL, ("show_data", {})).to_json())
    where = [str(tmp_path / "m.json"), "--base", str(tmp_path), "--organization", "org", "--company", "co"]
    assert main(["validate", *where]) == 0 and json.loads(capsys.readouterr().out)["final_columns"] == FINAL
    assert main(["run", *where]) == 0 and json.loads(capsys.readouterr().out)["rows"] == 100
    assert main(["schema"]) == 0 and "drop_column" in capsys.readouterr().out
    assert set(SCHEMAS) == set(REGISTRY) and action_schema("drop_column")["required"] == ["columns"]
    with pytest.raises(ConfigurationError):
        action_schema("nope")


def test_config_store(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path))
    store.put("o", "c1", "one", "rate(1 day)", "{}")
    store.put("o", "c1", "renamed", "rate(1 day)", "{}")
    store.put("o", "c2", "two", "rate(1 day)", "{}")
    store.delete("o", "c2")
    assert [r.name for r in store.of("o").collect()] == ["renamed"] and store.get("o", "c2").isEmpty()
    with pytest.raises(ValidationError):
        store.put("o", "c", "n", " ", "{}")
    assert store.get_settings("o") is None
    store.put_settings("o", {"auth_type": "bearer", "destination_url": "u"})
    assert store.get_settings("o")["destination_url"] == "u"
    with pytest.raises(ValidationError):
        store.put_settings("o", {"auth_type": "default"})
    assert [last_page(n, 20) for n in (0, 20, 21)] == [1, 1, 2]


def test_stream(env, spark, tmp_path):
    source = spark.createDataFrame([("1", "É"), ("2", "x")], "id string, v string")
    source.write.parquet(str(tmp_path / "in"))
    steps = manifest(("handle_diacritics", {"columns": ["v"]}), ("filter_by_value", {"column": "v", "pattern": "E"}))
    rows = stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), steps, env)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", "E")]
    for bad in ((("show_data", {}),), (("scd_type_2", {"entity_column": "id", "date_column": "v", "tie_break": ["v"]}), ("drop_column", {"columns": ["id"]}))):
        with pytest.raises(ConfigurationError):
            stream(rows, manifest(*bad), env)
    with pytest.raises(LogicError):
        stream(rows, manifest(("scd_type_2", {})), env)


def test_stateful_steps_of_a_stream(spark, small, tmp_path):
    """Rows are marked by their key, and then make a history of its changes."""
    rows = spark.read.parquet(f"{small}/customer.parquet").selectExpr("c_custkey", "string(c_custkey) AS id", "c_mktsegment AS segment", "c_acctbal AS balance")
    rows.write.parquet(str(tmp_path / "in"))
    steps = manifest(("identity_deduplicator", {"columns": ["segment"], "employee_id_column": "id", "order_column": "c_custkey"}), ("regex_replace", {"column": "segment", "pattern": "U.*", "replacement": ""}), ("scd_type_2", {"entity_column": "canonical_id", "date_column": "balance", "tie_break": ["c_custkey"]}))
    before = {k: spark.conf.get(k, None) for k in stateful.STATE}
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        marked = stream(source, manifest(*[(s.action_type, s.config) for s in steps.actions[:2]]), Environment(spark))
        marked.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start(str(tmp_path / "marked")).awaitTermination()
        again = spark.readStream.schema(marked.schema).parquet(str(tmp_path / "marked"))
        changes = stream(again, manifest(("scd_type_2", steps.actions[2].config)), Environment(spark))
        changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start(str(tmp_path / "changes")).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = stateful.latest(spark.read.parquet(str(tmp_path / "changes")), "canonical_id", ["c_custkey"])
    segments = rows.select("segment").distinct().count()
    assert got.count() == rows.count() and got.filter("is_current").count() == segments == got.select("canonical_id").distinct().count()
    assert marked.columns == [*rows.columns, "canonical_id", "is_duplicate"] and changes.columns == ["canonical_id", "effective_from", "c_custkey", "effective_to", "is_current", "version"]
    assert stream(source, steps, Environment(spark)).columns == changes.columns
