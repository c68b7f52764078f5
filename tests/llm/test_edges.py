"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest

from muster.llm import bpe, exact_dedup, hpylm, license_scan, mixing, quality_gbt, quality_rules, simhash, token_counts, url_filter
from pyspark.sql import functions as F
import public_tokenizers as P

RANKS = P.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "license": lambda d, labels: license_scan.license_scan(d, F.expr("concat_ws('/', source, lang, doc_id)")),
    "rules": quality_rules.quality_rules,
    "lm": lambda d, labels: hpylm.score(d),
    "mixing": lambda d, labels: mixing.scheduled(d).select("row.doc_id", "position"),
    "bpe": lambda d, labels: bpe.digests(d),
    "exact": lambda d, labels: exact_dedup.exact_dedup(d),
    "simhash": lambda d, labels: simhash.near_dedup(d),
    "gbt": quality_gbt.quality,
}
STAGES = {"rules": quality_rules.keep_good, "exact": lambda d, labels: exact_dedup.drop_copies(d), "simhash": lambda d, labels: simhash.drop_near_copies(d), "mixing": lambda d, labels: mixing.interleaved(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(odd, nothing, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    assert len(got) == 10
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([1, 2, 3, 4, None, 5, 6, 6, 7, 8], key=str)
    assert OPERATORS[name](nothing, labels).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(odd, nothing, labels, name):
    got = STAGES[name](odd, labels)
    assert got.columns == odd.columns
    rows = [tuple(r) for r in got.collect()]
    had = [tuple(r) for r in odd.collect()]
    assert all(r in had for r in rows)
    if name == "mixing":
        assert sorted(rows, key=str) == sorted(had, key=str)
    if name == "exact":
        assert sorted((r[0] for r in rows), key=str) == sorted([None, 3, 5, 6, 7, 8], key=str)
    if name == "simhash":
        assert sorted((r[0] for r in rows), key=str) == sorted([1, 2, None, 5, 8], key=str)
    empty = STAGES[name](nothing, labels)
    assert empty.columns == odd.columns and empty.collect() == []


#: Names that operators give to columns of their own, or that Spark gives.
NAMES = ("row", "at", "k", "t", "h", "s", "r", "o", "n", "w", "j", "i", "id", "position", "block_no", "before", "keep", "cold", "hot", "key", "digest", "fp", "root", "component", "trusted", "good", "file", "_metadata", "_at_file", "_at_row", "_mix_position", "_mix_s", "_verdict", "a.b")


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("stored", [True, False])
def test_no_name_clashes(spark, odd, labels, tmp_path, name, stored):
    docs = odd.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES if c != "digest"])
    if stored:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    got = STAGES[name](docs, labels)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == STAGES[name](odd, labels).count()
    assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in NAMES if c != "digest")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_do_not_look_at_other_columns(odd, labels, name):
    docs = odd.select("doc_id", "text", "source", "lang", *[F.lit("x").alias(c) for c in NAMES])
    assert sorted(map(str, OPERATORS[name](docs, labels).drop("score").collect())) == sorted(map(str, OPERATORS[name](odd, labels).drop("score").collect()))


def test_settings_stay_as_they_were(spark, odd, labels):
    before = dict(spark.conf.getAll)
    for name in OPERATORS:
        OPERATORS[name](odd, labels).count()
    assert {k: v for k, v in dict(spark.conf.getAll).items() if before.get(k) != v} == {}


def test_urls(spark):
    schema = "page_id bigint, url string, host string, verdict int"
    rows = [(1, None, "x", 1), (2, "", "x", 2), (None, "no scheme/casino", "x", 3), (4, "http://a.com?x" + "y" * 100_000, None, None), (4, "http://a.com?x" + "y" * 100_000, None, None)]
    got = url_filter.url_filter(spark.createDataFrame(rows, schema)).orderBy("page_id").collect()
    assert len(got) == 5
    assert [(r.page_id, r.host, r.verdict) for r in got] == [(None, "", "block"), (1, "", "allow"), (2, "", "allow"), (4, "a.com", "allow"), (4, "a.com", "allow")]
    assert url_filter.url_filter(spark.createDataFrame([], schema)).collect() == []


def test_sections(odd, nothing):
    got = token_counts.section_tokens(odd, RANKS, P.PATTERN).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, None, 5, 6, 7, 8}
    assert {r.doc_id: r.t for r in got}[2] == 0 and {r.doc_id: r.n for r in got}[2] == 1
    assert token_counts.section_tokens(nothing, RANKS, P.PATTERN).collect() == []
