"""Queries over the driver's tables, one or more for each operator, and SQL for the same results."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .context import ROW_ID, RosterContext, scratch, visible
from .operators.masking import Mask
from .plans.manifest import Environment, Manifest
from .plans.run_log import ConfigStore, RunLog, latest, listed, page
from .plans.runner import Outcome, prepare_sources, run, validate_pipeline
from .sinks.auth import auth_from, resolved
from .sinks.dispatch import Dispatcher, api_dispatcher, json_rows
from .sinks.show_data import show_data, shown
from .sources.clients import PagesOf, PostsTo, Response, Retry
from .sources.convert import SHEET, convert, csv_names, extension, is_csv, needs_recognition, recognised_table, recognised_tables, xlsx_table
from .sources.csv import Location, generic_ingestion
from .sources.readers import employee_source, worker_source
from .sources.sage import employees
from .sources.workday import workers
from .streaming import stateful

#: Rows of a workbook that a task writes, besides its header.
WORKBOOK_ROWS = 100_000
QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Countries that nations' keys stand for, in phone numbers.
DIALED = ["GB", "DE", "us", "NZL", "FR", "ES", "AU", "XX", "JPN", "IN"]


def query(sql: str | None = None):
    def put(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def ctx(spark: SparkSession, sf: str, name: str, *columns: str, order: str | None = None) -> RosterContext:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    df = df.selectExpr(*columns) if columns else df
    return RosterContext(df.withColumn(ROW_ID, F.col(order).cast("bigint")) if order else df)


def out(c: RosterContext) -> DataFrame:
    return visible(c.data)


@query("""SELECT event_id, ts AS effective_from, user_id, event_type, value, props,
  lead(ts) OVER w AS effective_to, lead(ts) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)""")
def scd_type_2(spark, sf):
    return out(ops.scd_type_2(ctx(spark, sf, "events"), "user_id", "ts", tie_break=["event_id"]))


@query("""SELECT event_id, ts AS effective_from, event_type, lead(ts) OVER w AS effective_to, lead(ts) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id)""")
def scd_type_2_hot_entities(spark, sf):
    """A few entities hold all rows."""
    return out(ops.scd_type_2(ctx(spark, sf, "events", "event_id", "ts", "event_type"), "event_type", "ts", tie_break=["event_id"]))


@query("""SELECT event_id, ts AS effective_from, lead(ts) OVER w AS effective_to, lead(ts) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (ORDER BY ts NULLS FIRST, event_id)""")
def scd_type_2_one_entity(spark, sf):
    c = ops.scd_type_2(ctx(spark, sf, "events", "event_id", "ts", "'all' AS entity"), "entity", "ts", tie_break=["event_id"])
    return out(ops.drop_column(c, ["entity"]))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate::VARCHAR AS effective_from, lead(l_shipdate::VARCHAR) OVER w AS effective_to,
  lead(l_shipdate::VARCHAR) OVER w IS NULL AS is_current
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate::VARCHAR NULLS FIRST, l_orderkey, l_linenumber)""")
def scd_type_2_hot_entities_by_texts(spark, sf):
    c = ctx(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "cast(l_shipdate as string) AS l_shipdate")
    return out(ops.scd_type_2(c, "l_returnflag", "l_shipdate", tie_break=["l_orderkey", "l_linenumber"]))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice AS effective_from, lead(o_totalprice) OVER w AS effective_to, lead(o_totalprice) OVER w IS NULL AS is_current
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice NULLS FIRST, o_orderkey)""")
def scd_type_2_hot_entities_by_numbers(spark, sf):
    c = ctx(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return out(ops.scd_type_2(c, "o_orderstatus", "o_totalprice", tie_break=["o_orderkey"]))


@query("""SELECT o_orderkey, o_custkey, o_orderdate AS effective_from, lead(o_orderdate) OVER w AS effective_to,
  lead(o_orderdate) OVER w IS NULL AS is_current
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)""")
def scd_type_2_ties(spark, sf):
    return out(ops.scd_type_2(ctx(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", tie_break=["o_orderkey"]))


@query("""SELECT doc_id, first_value(doc_id::VARCHAR) OVER w AS canonical_id, row_number() OVER w > 1 AS is_duplicate
  FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)""")
def identity_deduplicator(spark, sf):
    c = ctx(spark, sf, "documents", "doc_id", "text", "cast(doc_id as string) AS id", order="doc_id")
    return out(ops.identity_deduplicator(c, ["text"], "id")).select("doc_id", "canonical_id", "is_duplicate")


@query("""SELECT doc_id, first_value(doc_id::VARCHAR) OVER w AS canonical_id, row_number() OVER w > 1 AS is_duplicate
  FROM documents WINDOW w AS (PARTITION BY coalesce(nullif(source, 'src0'), lang) ORDER BY doc_id)""")
def identity_deduplicator_fallback(spark, sf):
    c = ctx(spark, sf, "documents", "doc_id", "nullif(source, 'src0') AS national_id", "lang AS email", "cast(doc_id as string) AS employee_id", order="doc_id")
    return out(ops.identity_deduplicator(c)).select("doc_id", "canonical_id", "is_duplicate")


@query("SELECT * FROM customer WHERE regexp_matches(c_mktsegment, '^(BUILDING|FURNITURE)$')")
def filter_by_value(spark, sf):
    return out(ops.filter_by_value(ctx(spark, sf, "customer"), "c_mktsegment", "^(BUILDING|FURNITURE)$"))


@query("SELECT c_custkey, regexp_replace(c_name, '0+', '_') AS c_name FROM customer")
def regex_replace(spark, sf):
    return out(ops.regex_replace(ctx(spark, sf, "customer", "c_custkey", "c_name"), "c_name", "0+", "_"))


#: Patterns that a backtracking engine takes long for, or a stack as deep as the text.
REPEATS, BETWEEN = r"(?:an|en|er|[ou]r)+ (?:[a-z]+,? )*[a-z]+\.", r"[aeiou]+[^aeiou\n]*(?:st|nd|x)+"


@query(f"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{REPEATS}')")
def filter_by_value_repeated_groups(spark, sf):
    return out(ops.filter_by_value(ctx(spark, sf, "documents", "doc_id", "text"), "text", REPEATS))


@query(f"SELECT doc_id, regexp_replace(text, '{BETWEEN}', '$1_') AS text FROM documents")
def regex_replace_repeated_groups(spark, sf):
    return out(ops.regex_replace(ctx(spark, sf, "documents", "doc_id", "text"), "text", BETWEEN, "$1_"))


@query("SELECT p_partkey AS part_key, p_name AS p_brand, p_brand AS p_name, p_type, p_size, p_retailprice FROM part")
def rename_column(spark, sf):
    return out(ops.rename_column(ctx(spark, sf, "part"), {"p_name": "p_brand", "p_brand": "p_name", "p_partkey": "part_key"}))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def drop_column(spark, sf):
    return out(ops.drop_column(ctx(spark, sf, "part"), ["p_type", "p_retailprice"]))


@query("""SELECT c_custkey, '***-**-' || CASE WHEN strlen(c_name) >= 4 THEN right(c_name, 4) ELSE '????' END AS c_name, 0::DOUBLE AS c_acctbal,
  0::BIGINT AS c_mktsegment FROM customer""")
def pii_masking(spark, sf):
    c = ctx(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return out(ops.pii_masking(c, [Mask("c_name"), Mask("c_acctbal", "zero"), Mask("c_mktsegment", "zero"), Mask("missing")]))


def _diacritics_sql() -> str:
    from .functions.text import PLAIN, WIDE

    sql = "text"
    for wide, narrow in WIDE.items():
        sql = f"replace({sql}, '{wide}', '{narrow}')"
    return f"translate({sql}, '{''.join(PLAIN.values())}', '{''.join(k * len(v) for k, v in PLAIN.items())}')"


@query(f"SELECT doc_id, {_diacritics_sql()} AS text FROM documents")
def handle_diacritics(spark, sf):
    return out(ops.handle_diacritics(ctx(spark, sf, "documents", "doc_id", "text"), ["text"]))


@query(f"SELECT doc_id, text, {_diacritics_sql()} AS text_ascii FROM documents")
def handle_diacritics_suffix(spark, sf):
    return out(ops.handle_diacritics(ctx(spark, sf, "documents", "doc_id", "text"), ["text"], "_ascii"))


@query("""SELECT doc_id, lang, CASE lang WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' END AS code2,
  CASE lang WHEN 'de' THEN 'DEU' WHEN 'fr' THEN 'FRA' WHEN 'es' THEN 'ESP' END AS code3 FROM documents""")
def iso_country_sanitizer(spark, sf):
    c = ops.iso_country_sanitizer(ctx(spark, sf, "documents", "doc_id", "lang"), "lang", "code2")
    return out(ops.iso_country_sanitizer(c, "lang", "code3", "alpha3"))


_COUNTRY = f"element_at(array({', '.join(repr(c) for c in DIALED)}), cast(c_nationkey % {len(DIALED)} as int) + 1)"


@query(f"""SELECT c_custkey, CASE WHEN dial IS NULL THEN digits ELSE '+' || dial || ' ' || regexp_replace(digits, '^0', '') END AS phone FROM (
  SELECT c_custkey, regexp_replace('0 7700 ' || lpad(c_custkey::VARCHAR, 6, '0'), '[^0-9+]', '', 'g') AS digits,
  (['44', '49', '1', '64', '33', '34', '61', NULL, '81', '91'])[c_nationkey % {len(DIALED)} + 1] AS dial FROM customer)""")
def cellphone_sanitizer(spark, sf):
    c = ctx(spark, sf, "customer", "c_custkey", "concat('0 7700 ', lpad(cast(c_custkey as string), 6, '0')) AS phone", f"{_COUNTRY} AS country", "cast(null as string) AS first_country")
    return out(ops.cellphone_sanitizer(c, "phone", ["first_country", "country"], "phone")).select("c_custkey", "phone")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def show_data_round_trip(spark, sf):
    path = scratch(spark, "show.csv")
    show_data(ctx(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey"), path)
    return shown(spark, path)


@query("""SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","missing":null,"big":' || CASE WHEN s_suppkey > 5 THEN 'true' ELSE 'false' END || '}' AS json FROM supplier""")
def api_payload(spark, sf):
    return json_rows(ctx(spark, sf, "supplier", "s_suppkey", "s_name", "cast(null as string) AS missing", "s_suppkey > 5 AS big").data)


@query(f"""WITH a AS (SELECT c_custkey, translate(c_name, 'é', 'e') AS c_name, c_nationkey, c_acctbal, c_mktsegment,
    (['GB', 'DE', 'US', 'NZ', 'FR', 'ES', 'AU', NULL, 'JP', 'IN'])[c_nationkey % {len(DIALED)} + 1] AS code,
    (['44', '49', '1', '64', '33', '34', '61', NULL, '81', '91'])[c_nationkey % {len(DIALED)} + 1] AS dial FROM customer),
  b AS (SELECT *, regexp_replace('7700' || lpad(c_custkey::VARCHAR, 6, '0'), '^0', '') AS digits FROM a),
  d AS (SELECT *, first_value(c_custkey::VARCHAR) OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS canonical_id FROM b)
  SELECT c_custkey::VARCHAR AS id, '***' || right(regexp_replace(c_name, '0', ''), 4) AS name, c_nationkey, 0::BIGINT AS salary, code AS country_code,
    CASE WHEN dial IS NULL THEN digits ELSE '+' || dial || ' ' || digits END AS phone, canonical_id,
    c_acctbal AS effective_from, lead(c_acctbal) OVER w AS effective_to, lead(c_acctbal) OVER w IS NULL AS is_current
  FROM d WHERE regexp_matches(c_mktsegment, 'U') WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def full_pipeline(spark, sf):
    c = ctx(spark, sf, "customer", "cast(c_custkey as string) AS c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "concat(c_mktsegment, '|', c_nationkey) AS email",
            f"{_COUNTRY} AS country", "concat('7700 ', lpad(cast(c_custkey as string), 6, '0')) AS mobile", "cast(c_acctbal as string) AS salary", "c_custkey AS o", order="c_custkey")
    c = ops.handle_diacritics(c, ["c_name"])
    c = ops.iso_country_sanitizer(c, "country", "country_code")
    c = ops.cellphone_sanitizer(c, "mobile", ["country_code"], "phone")
    c = ops.regex_replace(c, "c_name", "0", "")
    c = ops.identity_deduplicator(c, ["email"], "c_custkey")
    c = ops.filter_by_value(c, "c_mktsegment", "U")
    c = ops.scd_type_2(c, "c_nationkey", "c_acctbal", tie_break=["o"])
    c = ops.pii_masking(c, [Mask("c_name", mask_prefix="***"), Mask("salary", "zero")])
    c = ops.rename_column(c, {"c_custkey": "id", "c_name": "name"})
    return out(ops.drop_column(c, ["is_duplicate", "email", "country", "mobile", "c_mktsegment", "o"]))


@query(f"""SELECT 'cellphone_sanitizer' AS action_id, count(*) AS count FROM customer WHERE c_nationkey % {len(DIALED)} = 7
  UNION ALL SELECT 'filter_by_value', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'iso_country_sanitizer', count(*) FROM customer WHERE c_nationkey % {len(DIALED)} = 7""")
def warning_counts(spark, sf):
    c = ctx(spark, sf, "customer", "c_custkey", "c_mktsegment", "concat('0', c_custkey) AS phone", f"{_COUNTRY} AS country")
    c = ops.iso_country_sanitizer(c, "country", "code")
    c = ops.cellphone_sanitizer(c, "phone", ["code"], "phone")
    c = ops.filter_by_value(c, "c_mktsegment", "^BUILDING$")
    c.data.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(w.action_id, w.count) for w in c.warnings.drain()], "action_id string, count bigint")


def _runs(spark, sf) -> DataFrame:
    """Events as a log of runs: each user's run with a first and later events."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("at"), F.col("event_id").cast("int").alias("n"))


@query("""SELECT id, status, started_at FROM (SELECT user_id::VARCHAR AS id, event_type AS status, ts AS started_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def run_history_latest(spark, sf):
    return latest(_runs(spark, sf), "id").select("id", "status", "started_at")


@query("""SELECT id, status, started_at FROM (SELECT user_id::VARCHAR AS id, event_type AS status, ts AS started_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
  ORDER BY started_at DESC, id LIMIT 5 OFFSET 5""")
def run_history_page(spark, sf):
    return page(latest(_runs(spark, sf), "id").select("id", "status", "started_at"), 2, 5)


@query("SELECT 't' || n_regionkey AS table_id, (n_nationkey + 1)::INTEGER AS row_index, 1 AS column_index, 'nation ' || n_name AS text FROM nation")
def recognised_tables_query(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    none, no_ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    number = F.lit(None).cast("int")
    tables = n.groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit("c"), "n_nationkey")).alias("child_ids")).select(F.concat(F.lit("t"), "n_regionkey").alias("id"), F.lit("TABLE").alias("block_type"), none.alias("text"), number.alias("row_index"), number.alias("column_index"), "child_ids")
    cells = n.select(F.concat(F.lit("c"), "n_nationkey"), F.lit("Cell"), none, (F.col("n_nationkey") + 1).cast("int"), F.lit(1), F.array(F.concat(F.lit("v"), "n_nationkey"), F.concat(F.lit("w"), "n_nationkey")))
    words = n.select(F.concat(F.lit("w"), "n_nationkey"), F.lit("WORD"), F.col("n_name"), number, number, no_ids)
    nouns = n.select(F.concat(F.lit("v"), "n_nationkey"), F.lit("WORD"), F.lit("nation"), number, number, no_ids)
    return recognised_tables(tables.union(cells).union(words).union(nouns))


#: Customers of a page: more of them make more pages, not longer ones.
PAGE = 200


@query("SELECT c_custkey::VARCHAR AS worker_id, c_name AS first_name, c_mktsegment AS department, '' AS pay_rate_type FROM customer")
def soap_workers(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    worker = F.concat(F.lit("<wd:Worker><wd:WID>"), "c_custkey", F.lit("</wd:WID><wd:Legal_First_Name> "), "c_name", F.lit(" </wd:Legal_First_Name><wd:Department_Name>"), "c_mktsegment", F.lit("<x/></wd:Department_Name></wd:Worker>"))
    bodies = c.groupBy(F.expr(f"c_custkey div {PAGE}").alias("page")).agg(F.concat_ws("", F.collect_list(worker)).alias("body"))
    return workers(bodies).select("worker_id", "first_name", "department", "pay_rate_type")


def _soap_pages(spark, sf) -> str:
    """All customers as answers of a SOAP service, a page for each 200: the folder of pages."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    worker = F.concat(F.lit("<wd:Worker><wd:WID>"), "c_custkey", F.lit("</wd:WID><wd:Legal_First_Name> "), "c_name", F.lit(" </wd:Legal_First_Name><wd:Department_Name>"), "c_mktsegment", F.lit("<x/></wd:Department_Name></wd:Worker>"))
    last = c.agg(F.expr(f"max(c_custkey) div {PAGE} + 1")).first()[0]
    pages = c.groupBy(F.expr(f"c_custkey div {PAGE} + 1").alias("page")).agg(F.concat(F.lit(f"<wd:Total_Pages>{last}</wd:Total_Pages>"), F.concat_ws("", F.collect_list(worker))).alias("body"))
    pages.write.partitionBy("page").text(path := scratch(spark, "soap"))
    return path


@query("SELECT c_custkey::VARCHAR AS worker_id, c_name AS first_name, c_mktsegment AS department FROM customer")
def soap_workers_source(spark, sf):
    """Through Spark's reader: a partition for each page, and only the columns of the schema."""
    spark.dataSource.register(worker_source(PagesOf(_soap_pages(spark, sf))))
    options = {"tenant_url": "http://x", "tenant_id": "t", "username": "u", "password": "p"}
    return spark.read.format("muster_workers").schema("worker_id string, first_name string, department string").options(**options).load()


@query("SELECT c_custkey::VARCHAR AS id, c_name AS first_name, c_nationkey::VARCHAR AS team_id FROM customer")
def rest_employees_stream(spark, sf):
    """Through Spark's stream reader, page by page into a folder."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    last = c.agg(F.expr(f"max(c_custkey) div {PAGE} + 1")).first()[0]
    one = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"), F.col("c_nationkey").alias("team_id")))
    pages = c.groupBy(F.expr(f"c_custkey div {PAGE} + 1").alias("page")).agg(F.concat(F.lit('{"data":['), F.concat_ws(",", F.collect_list(one)), F.lit(f'],"meta":{{"total_pages":{last}}}}}')).alias("body"))
    pages.write.partitionBy("page").text(path := scratch(spark, "rest"))
    spark.dataSource.register(employee_source(PagesOf(path)))
    rows = spark.readStream.format("muster_employees").schema("id string, first_name string, team_id string").options(subdomain="x", api_token="t").load()
    at, got = scratch(spark, "employees-state"), scratch(spark, "employees")
    rows.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(got).awaitTermination()
    return spark.read.parquet(got)


@query("SELECT s_suppkey, s_name FROM supplier")
def dispatched_by_tasks(spark, sf):
    """What an endpoint gets when tasks post their batches."""
    c, to = ctx(spark, sf, "supplier", "s_suppkey", "s_name"), scratch(spark, "endpoint")
    api_dispatcher(c, Dispatcher(auth_from({"destination_url": "http://x", "token": "t"}), PostsTo(to), batch_rows=100, in_tasks=True)).release()
    bodies = spark.read.text(to, wholetext=True).select(F.from_json("value", "data array<struct<s_suppkey:bigint,s_name:string>>").alias("b"))
    return bodies.select(F.inline("b.data"))


def _streamed(spark, parts: list[DataFrame], step) -> DataFrame:
    """What a stateful step makes of tables that arrive one after the other, each as a micro-batch."""
    source, to = scratch(spark, "arrivals"), scratch(spark, "streamed")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
    before = {k: spark.conf.get(k, None) for k in stateful.STATE}
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
        step(rows).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start(to).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(to)


@query("""SELECT c_custkey, first_value(c_custkey::VARCHAR) OVER w AS canonical_id, row_number() OVER w > 1 AS is_duplicate
  FROM customer WINDOW w AS (PARTITION BY coalesce(nullif(c_mktsegment, 'BUILDING'), c_nationkey::VARCHAR) ORDER BY c_custkey)""")
def identity_deduplicator_stream(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey", "string(c_custkey) AS id", "nullif(c_mktsegment, 'BUILDING') AS segment", "string(c_nationkey) AS nation")
    third = c.agg(F.max("c_custkey")).first()[0] // 3 + 1
    parts = [c.filter((F.col("c_custkey") >= k * third) & (F.col("c_custkey") < (k + 1) * third)) for k in range(3)]
    return _streamed(spark, parts, lambda rows: stateful.identities(rows, ["segment", "nation"], "id", "c_custkey")).select("c_custkey", "canonical_id", "is_duplicate")


@query("""SELECT user_id, ts AS effective_from, event_id, lead(ts) OVER w AS effective_to, lead(ts) OVER w IS NULL AS is_current
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)""")
def scd_type_2_stream(spark, sf):
    """Events that come in no order: later micro-batches correct what earlier ones have said."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    parts = [e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
    changes = _streamed(spark, parts, lambda rows: stateful.history(rows, "user_id", "ts", ["event_id"]))
    return stateful.latest(changes, "user_id", ["event_id"])


@query("SELECT c_custkey::VARCHAR AS id, c_name AS first_name, '' AS email, c_nationkey::VARCHAR AS team_id, c_nationkey::VARCHAR AS post_code FROM customer")
def rest_employees(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    one = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"), F.col("c_nationkey").alias("team_id"), F.col("c_nationkey").alias("post_code")))
    bodies = c.groupBy(F.expr(f"c_custkey div {PAGE}").alias("page")).agg(F.concat(F.lit('{"data":['), F.concat_ws(",", F.collect_list(one)), F.lit('],"meta":{}}')).alias("body"))
    return employees(bodies).select("id", "first_name", "email", "team_id", "post_code")


#: Keys of countries as uploads write them; every third customer has one of them, the others none that is known.
COUNTRY_KEYS = ("GB", "gbr", " United Kingdom ", "uk", "Germany", "DEU", "brasil", "Holland", "USA", "america", "viet nam", "NZ", "Czechia", "czech republic", "XK", "kosovo", "Ivory Coast", "South Korea", "republic of korea", "nowhere", "", "Deutschland", "ESP", "espana")
_CODES = ("GB", "GB", "GB", "GB", "DE", "DE", "BR", "NL", "US", "US", "VN", "NZ", "CZ", "CZ", "XK", "XK", "CI", "KR", "KR", None, None, "DE", "ES", "ES")


@query(f"""SELECT c_custkey, ({[*COUNTRY_KEYS]})[c_custkey % {len(COUNTRY_KEYS)} + 1] AS country,
  ({[c or '' for c in _CODES]})[c_custkey % {len(COUNTRY_KEYS)} + 1] AS code FROM customer""")
def iso_country_names(spark, sf):
    names = ", ".join(f"'{c}'" for c in COUNTRY_KEYS)
    c = ctx(spark, sf, "customer", "c_custkey", f"element_at(array({names}), cast(c_custkey % {len(COUNTRY_KEYS)} as int) + 1) AS country")
    return out(ops.iso_country_sanitizer(c, "country", "code")).withColumn("code", F.coalesce("code", F.lit("")))


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """A file of these bytes, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    to = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    to.write(bytearray(data))
    to.close()
    return path


def _nations(spark: SparkSession, sf: str) -> list:
    """The 25 nations, whatever the tables' size."""
    return spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()


def _written_csv(spark: SparkSession, sf: str, name: str, columns: list[str], filename: str) -> Location:
    """A table as a company's CSV upload."""
    where = Location(scratch(spark, "uploads"), "org", "co")
    spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*columns).write.options(header=True, quote='"', escape='"').csv(where.source(filename))
    return where


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS \"the segment\" FROM customer")
def generic_ingestion_columns(spark, sf):
    where = _written_csv(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"], "people.xlsx")
    return out(generic_ingestion(spark, where, "people.csv", ["id", "name", "the segment"], many_lines=False))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents")
def generic_ingestion_line_feeds(spark, sf):
    """Texts with line feeds as cells of a CSV file that several tasks read."""
    where = Location(scratch(spark, "uploads"), "org", "co")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    docs.write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(where.source("texts.csv"))
    return out(generic_ingestion(spark, where, "texts.csv"))


def _upload(lines: DataFrame, before: str, after: str, name: str, between: str = "") -> str:
    """An upload of these lines (column ``line``, in any order) between two others, in parts: a task writes each."""
    spark, at = lines.sparkSession, f"{scratch(lines.sparkSession, 'file')}/{name}"
    ends = lambda x: spark.createDataFrame([(x,)], "line string").coalesce(1)
    if between:  # all lines but the first come after it
        first = lines.select(F.monotonically_increasing_id().alias("k")).agg(F.min("k")).first()[0]
        lines = lines.select(F.concat(F.when(F.monotonically_increasing_id() == first, F.lit("")).otherwise(F.lit(between)), "line").alias("line"))
    ends(before).union(lines).union(ends(after)).write.text(at)
    return at


@query("""SELECT l_orderkey::VARCHAR AS key, l_linenumber::VARCHAR AS line, l_returnflag AS flag, '{"state":"' || l_linestatus || '"}' AS more,
  CASE WHEN l_linenumber = 1 THEN '' ELSE 'x' END AS note FROM lineitem""")
def convert_json_array(spark, sf):
    """All of lineitem as one array of objects, uploaded in parts."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS key", "l_linenumber AS line", "l_returnflag AS flag", "struct(l_linestatus AS state) AS more", "if(l_linenumber = 1, '', 'x') AS note")
    return convert(spark, _upload(t.select(F.to_json(F.struct("*")).alias("line")), "[", "]", "lines.json", ","))


@query("SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status FROM orders")
def convert_json_longest(spark, sf):
    """The longer of two arrays of a root object that is uploaded in parts."""
    t = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS key", "o_orderstatus AS status")
    return convert(spark, _upload(t.select(F.to_json(F.struct("*")).alias("line")), '{"few":[{"a":1}],"n":5,"rows":[', "]}", "orders.json", ","), 1)


@query("SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, (o_custkey + 0.25)::VARCHAR AS amount FROM orders")
def convert_xlsx_sheet(spark, sf):
    """All of orders as sheets, which hold 1,048,576 rows at most by their format: tasks write workbooks and read them."""
    folder = scratch(spark, "workbook")
    t = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("bigint"), "o_orderstatus", (F.col("o_custkey") + F.lit(0.25)).cast("double").alias("amount"))

    def write(batches):
        import uuid
        from itertools import chain, islice

        import pyarrow as pa
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rows, row, name = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), None, None
        while name is None or (row := next(rows, None)):
            name = f"orders-{uuid.uuid4().hex}.xlsx"
            with fs.open_output_stream(f"{base}/{name}") as to, zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{relation}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
                with z.open("xl/worksheets/sheet1.xml", "w") as entry:
                    entry.write(f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData><row r="1">'.encode() + b"".join(b'<c t="inlineStr"><is><t>%s</t></is></c>' % n for n in (b"key", b"status", b"amount")) + b"</row>")
                    for k, s, a in islice(chain([row] if row else [], rows), WORKBOOK_ROWS):
                        entry.write(f'<row><c><v>{k}</v></c><c t="inlineStr"><is><t>{s}</t></is></c><c><v>{a}</v></c></row>'.encode())
                    entry.write(b"</sheetData></worksheet>")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r["name"] for r in t.mapInArrow(write, "name string").collect()]
    return xlsx_table(spark, [f"{folder}/{n}" for n in names])


@query("""SELECT o_orderkey::VARCHAR AS Key, o_orderstatus AS Status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a & b ' || o_custkey END AS Note FROM orders""")
def convert_xml_records(spark, sf):
    """All of orders as elements with a prefix, uploaded in parts and cut up among tasks."""
    t = spark.read.parquet(f"{sf}/orders.parquet")
    one = F.concat(F.lit('<o:Order id="1"><o:Key>'), "o_orderkey", F.lit("</o:Key><o:Status> "), "o_orderstatus", F.lit(" </o:Status>"), F.when(F.expr("o_orderkey % 3 = 0"), "<o:Note/>").otherwise(F.concat(F.lit("<o:Note><b>a &amp; b</b>"), "o_custkey", F.lit("</o:Note>"))), F.lit("</o:Order>"))
    got = convert(spark, _upload(t.select(one.alias("line")), '<o:Orders xmlns:o="u"><Head>x</Head>', "</o:Orders>", "orders.xml"))
    return got.select("Key", "Status", "Note")


MANIFEST = {
    "version": "1.0",
    "actions": [
        {"id": "in", "action_type": "generic_ingestion_connector", "config": {"filename": "people.csv", "columns": ["c_custkey", "c_name", "c_mktsegment", "country"], "multi_line": False}},
        {"id": "keep", "action_type": "filter_by_value", "config": {"column": "c_mktsegment", "pattern": "^[A-F]"}},
        {"id": "country", "action_type": "iso_country_sanitizer", "config": {"source_column": "country", "output_column": "code", "output_format": "alpha3"}},
        {"id": "mask", "action_type": "pii_masking", "config": {"columns": [{"name": "c_name", "keep_last": 3, "mask_prefix": "#"}]}},
        {"id": "ids", "action_type": "rename_column", "config": {"mapping": {"c_custkey": "employee_id"}}},
        {"id": "fewer", "action_type": "drop_column", "config": {"columns": ["country"]}},
        {"id": "out", "action_type": "show_data", "config": {}},
    ],
}
_MANIFEST_SQL = """SELECT c_custkey::VARCHAR AS employee_id, '#' || right(c_name, 3) AS c_name, c_mktsegment,
  (['FRA', 'DEU', 'ESP'])[c_custkey % 3 + 1] AS code FROM customer WHERE c_mktsegment SIMILAR TO '[A-F].*'"""


def _manifest_env(spark: SparkSession, sf: str) -> Environment:
    country = "element_at(array('France', 'de', 'espana'), cast(c_custkey % 3 as int) + 1) AS country"
    return Environment(spark, _written_csv(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", country], "people.csv"))


@query(_MANIFEST_SQL)
def manifest_run(spark, sf):
    """JSON to steps, all steps in one run, and the snapshot that its sink has written."""
    env = _manifest_env(spark, sf)
    got = run(Manifest.parse(json.dumps(MANIFEST)), env)
    assert got.status == "success", got
    return shown(spark, env.location.output("out"))


@query("""SELECT * FROM (VALUES ('in', 'generic_ingestion_connector', ''), ('keep', 'filter_by_value', ''), ('country', 'iso_country_sanitizer', 'code'),
  ('mask', 'pii_masking', 'code'), ('ids', 'rename_column', 'code'), ('fewer', 'drop_column', 'code'), ('out', 'show_data', 'code')) t(action_id, action_type, last_column)""")
def manifest_validation(spark, sf):
    """Columns after every step of the manifest, without a job."""
    got = validate_pipeline(Manifest.parse(MANIFEST), Environment(spark))
    return spark.createDataFrame([(s.action_id, s.action_type, "code" if "code" in s.columns_after else "") for s in got.steps], "action_id string, action_type string, last_column string")


@query("""SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'ok' WHEN n_nationkey % 3 = 1 THEN 'missing n_name' ELSE 'not a sink' END AS verdict FROM nation""")
def manifest_validation_of_sinks(spark, sf):
    """Whether the last step is a sink, and whether it has the columns that its endpoint asks for."""
    source = {"id": "a", "action_type": "generic_ingestion_connector", "config": {"filename": "x.csv", "columns": ["n_nationkey", "n_name"]}}
    post = {"id": "c", "action_type": "api_dispatcher", "config": {"destination_url": "http://x", "schema": {"n_name": "string"}}}
    drop = {"id": "b", "action_type": "drop_column", "config": {"columns": ["n_name"]}}
    said = []
    for steps in ([source, post], [source, drop, post], [source, drop]):
        try:
            validate_pipeline(Manifest.parse({"version": "1", "actions": steps}), Environment(spark))
            said.append("ok")
        except Exception as e:
            said.append("not a sink" if "must be a sink" in str(e) else f"missing {str(e).rpartition(': ')[2]}")
    cases = F.array(*map(F.lit, said))
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", cases[F.col("n_nationkey") % 3].alias("verdict"))


_NATION_TEXTS = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


@query(_NATION_TEXTS)
def convert_csv(spark, sf):
    rows = "".join(f'{r.n_nationkey},"{r.n_name}",{r.n_regionkey}\n' for r in _nations(spark, sf))
    return visible(convert(spark, _put(spark, scratch(spark, "a.csv"), f"n_nationkey,n_name,n_regionkey\n{rows}".encode())))


@query(_NATION_TEXTS)
def convert_json(spark, sf):
    """The longer of two arrays of the root object."""
    data = json.dumps({"few": [{"a": 1}], "nations": [r.asDict() for r in _nations(spark, sf)]})
    return convert(spark, _put(spark, scratch(spark, "a.json"), data.encode()), 1)


@query(_NATION_TEXTS)
def convert_xml(spark, sf):
    rows = "".join(f"<Nation><n_nationkey> {r.n_nationkey} </n_nationkey><n_name>{r.n_name}</n_name><n_regionkey>{r.n_regionkey}</n_regionkey></Nation>" for r in _nations(spark, sf))
    return convert(spark, _put(spark, scratch(spark, "a.xml"), f"<Nations><Head>x</Head>{rows}</Nations>".encode()))


def _workbook(rows: list[list]) -> bytes:
    """Two sheets, the rows in the second; the last column is a date."""
    main, rel = SHEET.strip("{}"), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c s="{int(k == 3)}"><v>{v}</v></c>' for k, v in enumerate(r))
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>')
    return to.getvalue()


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, (DATE '2024-01-01' + n_nationkey)::VARCHAR AS day FROM nation")
def convert_xlsx(spark, sf):
    """The second sheet of a workbook, with dates (45292 is the first of January 2024)."""
    rows = [["n_nationkey", "n_name", "n_regionkey", "day"], *[[r.n_nationkey, r.n_name, float(r.n_regionkey), 45292 + r.n_nationkey] for r in _nations(spark, sf)]]
    return convert(spark, _put(spark, scratch(spark, "a.xlsx"), _workbook(rows)), 1, iso_dates=True)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, (45292 + n_nationkey)::VARCHAR AS day FROM nation")
def conversion_flow(spark, sf):
    """A manifest's upload, by its table_index, becomes the CSV that its source reads."""
    rows = [["n_nationkey", "n_name", "n_regionkey", "day"], *[[r.n_nationkey, r.n_name, float(r.n_regionkey), 45292 + r.n_nationkey] for r in _nations(spark, sf)]]
    env, uploads = Environment(spark, Location(scratch(spark, "company"), "org", "co")), scratch(spark, "uploads")
    _put(spark, f"{uploads}/staff.xlsx", _workbook(rows))
    steps = [{"id": "in", "action_type": "generic_ingestion_connector", "config": {"filename": "staff.xlsx", "table_index": 1}}, {"id": "out", "action_type": "show_data", "config": {}}]
    manifest = Manifest.parse({"version": "1", "actions": steps})
    assert prepare_sources(manifest, env, uploads) == {"in": ("converted", rows[0])}
    assert run(manifest, env).status == "success"
    return shown(spark, env.location.output("out"))


@query("SELECT 'nation ' || n_name AS \"the name\", n_nationkey::VARCHAR AS \"column_2\" FROM nation WHERE n_regionkey = 1")
def recognised_table_grid(spark, sf):
    """The second recognised table, its first row as the header; a header without words is named by its column."""
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("i", F.expr("1 + (n_nationkey div 5)"))
    word = lambda ident, said: F.struct(ident.alias("id"), F.lit("WORD").alias("block_type"), said.alias("text"), F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("column_index"), F.array().cast("array<string>").alias("child_ids"))
    cell = lambda ident, row, column, *words: F.struct(ident.alias("id"), F.lit("CELL").alias("block_type"), F.lit(None).cast("string").alias("text"), row.cast("int").alias("row_index"), F.lit(column).alias("column_index"), F.array(*words).cast("array<string>").alias("child_ids"))
    key = lambda x: F.concat(F.lit(x), F.col("n_nationkey"))
    blocks = n.select(F.inline(F.array(cell(key("c"), F.col("i") + 1, 1, F.lit("nation"), key("w")), cell(key("d"), F.col("i") + 1, 2, key("v")), word(key("w"), F.col("n_name")), word(key("v"), F.col("n_nationkey").cast("string")))))
    table = n.groupBy("n_regionkey").agg(F.flatten(F.collect_list(F.array(key("c"), key("d")))).alias("c"))
    table = table.select(F.concat(F.lit("t"), "n_regionkey").alias("id"), F.lit("TABLE").alias("block_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("column_index"), F.array_append("c", F.lit("head")).alias("child_ids"))
    one = spark.range(1).select(F.inline(F.array(cell(F.lit("head"), F.lit(1), 1, F.lit("the"), F.lit("name")), word(F.lit("the"), F.lit("the")), word(F.lit("name"), F.lit("name")), word(F.lit("nation"), F.lit("nation")))))
    return recognised_table(blocks.union(table).union(one), 1)


@query("""SELECT n_name || '.' || ext AS file, lower(ext) AS extension, lower(ext) = 'csv' AS csv, lower(ext) IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'tif') AS recognise
  FROM (SELECT n_name, (['csv', 'CSV', 'pdf', 'Png', 'tiff', 'xlsx', 'json'])[n_nationkey % 7 + 1] AS ext FROM nation)""")
def file_kinds(spark, sf):
    kinds = ("csv", "CSV", "pdf", "Png", "tiff", "xlsx", "json")
    names = [f"{r.n_name}.{kinds[r.n_nationkey % 7]}" for r in _nations(spark, sf)]
    return spark.createDataFrame([(n, extension(n), is_csv(n), needs_recognition(n)) for n in names], "file string, extension string, csv boolean, recognise boolean")


@query("SELECT n_name AS name, n_nationkey + 1 AS place FROM nation")
def csv_header(spark, sf):
    """A quick look at a header that holds every nation's name, quoted or with blanks."""
    names = [f'"{r.n_name}"' if r.n_nationkey % 2 else f" {r.n_name} " for r in _nations(spark, sf)]
    got = csv_names(spark, _put(spark, scratch(spark, "h.csv"), (",".join([*names[:3], "", *names[3:]]) + "\n1,2\n").encode()))
    return spark.createDataFrame([(n, k + 1) for k, n in enumerate(got)], "name string, place int")


@query("SELECT s_suppkey, s_name, 'Bearer t' AS authorization, (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 + 1 AS request FROM supplier")
def dispatched(spark, sf):
    """What the endpoint gets: batches of seven rows, each with its authorization."""
    seen = []
    send = lambda method, url, headers, body: seen.append((headers["Authorization"], json.loads(body)["data"])) or Response(200, "")
    c = ctx(spark, sf, "supplier", "s_suppkey", "s_name", order="s_suppkey")
    api_dispatcher(c, Dispatcher(auth_from({"destination_url": "http://x", "token": "t"}), send, batch_rows=7)).release()
    rows = [(r["s_suppkey"], r["s_name"], auth, k + 1) for k, (auth, data) in enumerate(seen) for r in data]
    return spark.createDataFrame(rows, "s_suppkey bigint, s_name string, authorization string, request bigint")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 2 THEN 'http://x/?a=1&key=' || n_name ELSE 'http://x/?a=1' END AS url,
  CASE n_nationkey % 4 WHEN 0 THEN 'Authorization' WHEN 1 THEN 'X-Own' WHEN 3 THEN 'X-More' ELSE '' END AS header,
  CASE n_nationkey % 4 WHEN 0 THEN 'Bearer ' || n_name WHEN 1 THEN n_name WHEN 3 THEN 'v' ELSE '' END AS value FROM nation""")
def auth_bearer(spark, sf):
    """A token in the Authorization header, in a header of its own, in the query, and no authentication; by the default of an organisation."""
    how = ({}, {"placement": "custom_header", "placement_key": "X-Own"}, {"placement": "query_param", "placement_key": "key"}, {"auth_type": "none", "token": None, "extra_headers": {"X-More": "v"}})
    rows = []
    for r in _nations(spark, sf):
        own = {"destination_url": "http://x/?a=1", "token": r.n_name} | how[r.n_nationkey % 4]
        url, headers = resolved(auth_from({"auth_type": "default"}), own).request(None)
        ((name, value),) = headers.items() or (("", ""),)
        rows.append((r.n_nationkey, url, name, value))
    return spark.createDataFrame(rows, "n_nationkey int, url string, header string, value string")


@query("""SELECT 'oauth1' AS kind, 'OAuth oauth_consumer_key="dpf43f3p2l4k3l03", oauth_nonce="kllo9940pd9333jh", oauth_signature="/", oauth_signature_method="HMAC-SHA1", oauth_timestamp="1191242096", oauth_token="nnch734d00sl2jdk", oauth_version="1.0"' AS authorization
  UNION ALL SELECT 'oauth2 first', 'Bearer t1' UNION ALL SELECT 'oauth2 kept', 'Bearer t1' UNION ALL SELECT 'oauth2 renewed', 'Bearer t2' UNION ALL SELECT 'refresh token', 'r0 r1'""")
def auth_tokens(spark, sf):
    """Signed requests (the signature itself is left to the tests), tokens that are kept until they end, and refresh tokens."""
    import re

    one = auth_from({"auth_type": "oauth1", "destination_url": "http://photos.example.net/photos?size=original", "consumer_key": "dpf43f3p2l4k3l03", "consumer_secret": "kd94hf93k423kf44", "access_token": "nnch734d00sl2jdk", "token_secret": "pfkkdhi9sl3r4s00"})
    rows, now, asked = [("oauth1", re.sub('oauth_signature="[^"]*"', 'oauth_signature="/"', one.signed("kllo9940pd9333jh", 1191242096)))], [0.0], []

    def endpoint(method, url, headers, body):
        asked.append(body.decode())
        return Response(200, json.dumps({"access_token": f"t{len(asked)}", "expires_in": 100, "refresh_token": f"r{len(asked)}"}))

    two = auth_from({"auth_type": "oauth2", "destination_url": "http://x", "client_id": "c", "client_secret": "s", "token_url": "http://t", "grant_type": "authorization_code", "refresh_token": "r0"})
    two.clock = lambda: now[0]
    for kind, at in (("oauth2 first", 0), ("oauth2 kept", 69), ("oauth2 renewed", 70)):
        now[0] = at
        rows.append((kind, two.request(endpoint)[1]["Authorization"]))
    rows.append(("refresh token", " ".join(re.search("refresh_token=([^&]*)", a)[1] for a in asked)))
    return spark.createDataFrame(rows, "kind string, authorization string")


@query("""SELECT n_nationkey, least(n_nationkey % 5 + 1, 4) AS attempts, CASE WHEN n_nationkey % 5 >= 4 THEN 503 ELSE 200 END AS status,
  0.5 * (2 ** least(n_nationkey % 5, 3) - 1) AS waited FROM nation""")
def retries(spark, sf):
    """An endpoint that fails n times: attempts, the last status, and pauses that double."""
    rows = []
    for r in _nations(spark, sf):
        answers, pauses, calls = [503] * (r.n_nationkey % 5) + [200], [], []
        got = Retry(sleep=pauses.append).run(lambda: Response(calls.append(1) or answers[len(calls) - 1], ""))
        rows.append((r.n_nationkey, len(calls), got.status, float(sum(pauses))))
    return spark.createDataFrame(rows, "n_nationkey int, attempts int, status int, waited double")


@query("SELECT * FROM (VALUES ('runs', 3), ('success', 1), ('failed', 1), ('running', 1), ('refused', 1), ('one', 1), ('rows', 7), ('last page', 2), ('on page 2', 1)) t(what, n)")
def run_log(spark, sf):
    """Records of three runs: one ends well, one fails, one goes on and keeps another from beginning."""
    log = RunLog(spark, scratch(spark, "runs"), "org", "co")
    manifest = Manifest.parse(MANIFEST)
    for outcome in (Outcome("success", 7, []), Outcome("failed", None, [], "no", "keep")):
        log.end(log.begin(manifest), outcome)
    last, refused = log.begin(manifest), 0
    try:
        log.begin(manifest)
    except Exception:
        refused = 1
    runs = log.runs().collect()
    second = listed(log.runs(), 2, 2)
    said = {"runs": log.count(), "refused": refused, "one": log.one(last).count(), "rows": sum(r.rows_processed or 0 for r in runs), "last page": second["last_page"], "on page 2": len(second["data"])}
    said |= {s: sum(r.status == s for r in runs) for s in ("success", "failed", "running")}
    return spark.createDataFrame(list(said.items()), "what string, n int")


@query("SELECT n_name AS company, CASE WHEN n_nationkey = 3 THEN '0 1 * * *' ELSE n_nationkey || ' 0 * * *' END AS cron, 'Bearer' AS scheme FROM nation WHERE n_nationkey < 6 AND n_nationkey <> 2")
def config_store(spark, sf):
    """Pipelines of six companies, of which one is changed and one deleted, and the organisation's default authentication."""
    store = ConfigStore(spark, scratch(spark, "configs"))
    names = [r.n_name for r in _nations(spark, sf)[:6]]
    for k, name in enumerate(names):
        store.put("org", name, name, f"{k} 0 * * *", json.dumps(MANIFEST))
    store.put("org", names[3], names[3], "0 1 * * *", json.dumps(MANIFEST))
    store.delete("org", names[2])
    store.put_settings("org", {"destination_url": "http://x", "token": "t"})
    scheme = auth_from(store.get_settings("org")).request(None)[1]["Authorization"].split()[0]
    return store.of("org").select(F.col("customerCompanyId").alias("company"), "cron", F.lit(scheme).alias("scheme"))
