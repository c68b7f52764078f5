import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from muster import operators as ops
from muster.context import ROW_ID, RosterContext, numbered
from muster.errors import ConfigurationError, LogicError
from muster.functions import lookups, patterns
from muster.functions.text import PLAIN, WIDE
from muster.operators import scd
from muster.operators.masking import Mask
from muster.plans.manifest import masks


def ctx(spark, schema, *rows):
    return RosterContext(numbered(spark.createDataFrame(list(rows), schema).coalesce(1)))


def col(c, name):
    return [r[name] for r in c.data.orderBy(ROW_ID).select(name).collect()]


def test_scd_closes_each_row_by_the_next(spark):
    c = ctx(spark, "employee_id string, salary long, start_date string", ("1", 10, "2024-01-01"), ("1", 20, "2024-06-01"), ("2", 5, "2024-02-01"), ("2", 6, "2024-08-01"))
    got = ops.scd_type_2(c)
    assert col(got, "is_current") == [False, True, False, True]
    assert col(got, "effective_to") == ["2024-06-01", None, "2024-08-01", None]
    assert "start_date" not in got.columns and got.metadata["effective_to"].source == "LOGIC_ACTION"


def test_scd_null_dates_come_first_and_null_entities_are_one_group(spark):
    c = ctx(spark, "e string, d string", (None, "2"), (None, None), (None, "1"))
    got = ops.scd_type_2(c, "e", "d")
    assert col(got, "effective_from") == [None, "1", "2"] and col(got, "effective_to") == ["1", "2", None]
    with pytest.raises(LogicError):
        ops.scd_type_2(c, "e", "e")
    with pytest.raises(LogicError):
        ops.scd_type_2(c, "e", "missing")


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "int"])
def test_scd_by_slices_gives_the_same(spark, kind):
    days = [None, "2024-01-31", "2024-01-31", "2024-02-01", "2024-05-05", "2023-12-31", "2024-01-01"]
    rows = [(e, d) for e in ("a", None, "b", "__slice") for d in (days if e != "b" else days[1:2])]
    df = spark.createDataFrame(rows, "e string, d string").coalesce(1)
    df = df.withColumn("d", F.expr("cast(replace(d, '-', '') as int)" if kind == "int" else f"cast(d as {kind})")).withColumn("__slice", F.lit("x"))
    c = RosterContext(numbered(df))
    want, got = (sorted(map(str, ops.scd_type_2(c, "e", "d", split_entities=s).data.drop(ROW_ID).collect())) for s in (False, True))
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "int", "double", "decimal(9,1)"])
def test_scd_of_large_entities(spark, kind):
    """Entities with most of the rows, one of them null, with dates of any type, ties and nulls: as by one sort of each."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None, "b", f"e{k}"]), None if k % 90 == 0 else rng.choice([rng.randint(0, 4000), rng.randint(0, 30)]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "e string, n int, id int").repartition(5)
    d = {"string": "concat('d', n)", "date": "date_add(date'2020-01-01', n)", "timestamp": "timestamp_seconds(n)"}.get(kind, f"cast(n as {kind})")
    df = df.withColumn("d", F.expr(d)).withColumn("__hot", F.lit("x"))
    want, got = (sorted(map(str, ops.scd_type_2(RosterContext(df), "e", "d", tie_break=["id"], split_entities=s).data.collect())) for s in (False, True))
    assert got == want and len(got) == 4000


def test_no_task_sorts_more_than_its_share(spark, small):
    """One entity holds all events."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    df = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", F.lit("all").alias("e"))
    ranges = scd._ranges(df, "e", [F.col("ts"), F.col("event_id")])
    (row,) = ranges.collect()
    assert len(row.bounds) >= 60 and [b for g in row.groups for b in g] == row.bounds == sorted(row.bounds)
    got = ops.scd_type_2(RosterContext(df), "e", "ts", tie_break=["event_id"]).data
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("effective_to").alias("count")).collect()]
    rows = sorted(df.collect(), key=lambda r: (r.ts, r.event_id))
    dates = {r.event_id: r.effective_to for r in got.collect()}
    assert [dates[r.event_id] for r in rows] == [*[r.ts for r in rows[1:]], None]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks) < 0.5 * len(rows)


def test_small_entities_are_not_split(spark):
    df = spark.range(3000).selectExpr("string(id % 1500) AS e", "id AS d")
    assert scd._ranges(df, "e", [F.col("d")]) is None and scd._ranges(df.limit(0), "e", [F.col("d")]) is None


def test_dedup_marks_all_but_the_first(spark):
    c = ctx(spark, "employee_id string, email string", ("001", "a"), ("002", "a"), ("003", "b"), ("004", None), (None, None), ("006", ""), ("007", ""))
    got = ops.identity_deduplicator(c, ["email"])
    assert col(got, "canonical_id") == ["001", "001", "003", "004", "unknown", "006", "006"]
    assert col(got, "is_duplicate") == [False, True, False, False, False, False, True]


def test_dedup_falls_back_and_skips(spark):
    c = ctx(spark, "employee_id string, national_id string, email string", ("1", None, "x"), ("2", "n", "x"), ("3", None, "x"))
    assert col(ops.identity_deduplicator(c), "is_duplicate") == [False, False, True]
    bare = ctx(spark, "employee_id string, salary long", ("1", 1))
    got = ops.identity_deduplicator(bare)
    assert got.columns == ["employee_id", "salary"]
    assert "no identity column among national_id, email" in got.warnings.drain()[0].message
    with pytest.raises(LogicError):
        ops.identity_deduplicator(ctx(spark, "email string", ("x",)))


def test_dedup_by_a_key_that_most_rows_share(spark):
    """Names of columns that the operator could use itself stay as they are."""
    c = ctx(spark, "employee_id string, email string, __key string, __first string", *[(str(k), "" if k % 4 else None, "a", "b") for k in range(40)])
    got = ops.identity_deduplicator(c, ["email"])
    assert col(got, "is_duplicate") == [bool(k % 4) and k > 1 for k in range(40)] and col(got, "canonical_id") == [str(k) if not k % 4 else "1" for k in range(40)]
    assert col(got, "__key") == ["a"] * 40 and got.columns == ["employee_id", "email", "__key", "__first", "canonical_id", "is_duplicate"]


def test_masking(spark):
    c = ctx(spark, "ssn string, salary string, pay int", ("123-45-6789", "10", 7), ("abc", None, None), (None, "x", 1), ("6789", "1", 2), ("zäöü", "1", 2))
    got = ops.pii_masking(c, [Mask("ssn"), Mask("salary", "zero"), Mask("pay", "zero"), Mask("gone")])
    assert col(got, "ssn") == ["***-**-6789", "***-**-????", None, "***-**-6789", "***-**-öü"]
    assert col(got, "salary") == [0] * 5 and got.data.schema["salary"].dataType.simpleString() == "bigint" and got.data.schema["pay"].dataType.simpleString() == "int"
    assert len(got.warnings.drain()) == 1
    assert col(ops.pii_masking(ctx(spark, "s string", ("€€",)), [Mask("s")]), "s") == ["***-**-€"]
    assert col(ops.pii_masking(ctx(spark, "s string", ("ab",)), [Mask("s", keep_last=0)]), "s") == ["***-**-"]
    with pytest.raises(LogicError):
        ops.pii_masking(c, [Mask("pay")])
    assert masks({}) == [Mask("ssn"), Mask("salary", "zero")] and masks({"mask_ssn": False}) == [Mask("salary", "zero")]
    assert masks({"columns": [{"name": "a", "strategy": "other"}]}) == [Mask("a")]


def test_filter_finds_and_counts(spark):
    c = ctx(spark, "id string, v string", ("1", "Engineering"), ("2", "Sales"), ("3", None), ("4", ""), ("5", "Engineering\n"))
    got = ops.filter_by_value(c, "v", "^Engineering$")
    assert col(got, "id") == ["1"]
    got.data.count()
    assert col(ops.filter_by_value(c, "v", "."), "id") == ["1", "2", "5"]
    with pytest.raises(LogicError):
        ops.filter_by_value(c, "w", "x")
    with pytest.raises(ConfigurationError):
        ops.filter_by_value(c, "", "x")


def test_filter_warning(spark):
    c = ctx(spark, "v string", ("a",), ("b",), ("b",))
    got = ops.filter_by_value(c, "v", "a")
    got.data.collect()
    (w,) = got.warnings.drain()
    assert (w.message, w.count) == ("'v': 2 of 3 row(s) dropped", 2)


@pytest.mark.parametrize(
    ("value", "pattern", "replacement", "want"),
    [("+44 7700", r"\+44\s?", "0", "07700"), ("aaa", "a", "X", "Xaa"), ("ab", "(a)", "$1\\", "$1\\b"), ("😀ab", "a", "X", "😀Xb"), ("a\nb", "b$", "c", "a\nc"), ("a\n", "a$", "c", "a\n"), ("٣", r"\d", "3", "3"), (None, "a", "b", None), ("abc", "", "x", None), ("xy", "z*", "-", "-xy"), ("a:b", "[[:punct:]]", "_", "a_b")],
)
def test_replace_first(spark, value, pattern, replacement, want):
    c = ctx(spark, "v string", (value,))
    if not pattern:
        with pytest.raises(ConfigurationError):
            ops.regex_replace(c, "v", pattern, replacement)
        return
    assert col(ops.regex_replace(c, "v", pattern, replacement), "v") == [want]


@pytest.mark.parametrize("bad", ["", "a" * 129, "((((a))))", "(a)(b)", "(?=a)", "(?<!a)", r"(a)\1", "a++", "(", "a{5000}", "[[:nope:]]"])
def test_patterns_that_are_refused(spark, bad):
    with pytest.raises(ConfigurationError):
        patterns.compiled(bad)


#: Patterns, whether the JVM may run them when searched for, and when replaced.
ENGINES = [
    ("abc", 1, 1), ("0+", 1, 1), ("a+b", 1, 0), (r"\s+$", 1, 0), ("a*b", 1, 0), ("ba*", 1, 1), ("^a*b", 1, 1), ("^a*b*c", 0, 0), ("^(BUILDING|FURNITURE)$", 1, 1), ("(?:a|b)*c", 1, 0), ("x(?:a|b)*c", 0, 0), ("x(?:ab|b)*c", 0, 0), ("(x+x+)+y", 0, 0),
    ("z(x+x+)+y", 0, 0), ("(?:a?){30}a{30}", 0, 0), (r"\d{4}-\d{2}", 1, 1), (".*,.*", 1, 0), ("(?:ab){1000}", 0, 0), ("(?i)b[aeiou]*n", 0, 0), ("(?m)^a*b", 0, 0), (r"\bfoo\b", 1, 1), (r"é\w*x", 0, 0), ("a(?:b|)+c", 0, 0),
]


@pytest.mark.parametrize("pattern, searched, replaced", ENGINES)
def test_engines(spark, pattern, searched, replaced):
    """Long values take neither engine deep stacks or long; both say the same as a plain matcher does on short ones."""
    assert [patterns.compiled(pattern, s).java is not None for s in (True, False)] == [bool(searched), bool(replaced)]
    long = [x * (1_000_000 // len(x)) for x in ("a", "ab", "x", "xx y", "b ", "é", "ba", "foo")]
    short = ["", "a", "b", "aab", "c", "abab c", "xababc", "xxxxy", "zxxy", "BUILDING", "x,y", "BAEN", "\nb", "aaab\nab", "a foo b", "2024-01-02", "abc", "ac", "éaéx", "\t \n", "é x"]
    df = spark.createDataFrame([(x,) for x in long + short], "v string").repartition(2)
    began = time.monotonic()
    got = {r.v: (r.f, r.r) for r in df.select("v", patterns.found(F.col("v"), pattern).alias("f"), patterns.replace_first(F.col("v"), pattern, "<$1\\>").alias("r")).collect()}
    assert time.monotonic() - began < 60
    for x in short:
        want = re.search(pattern.replace("$", r"\Z"), x)
        assert got[x] == ((want is not None), x if want is None else x[: want.start()] + "<$1\\>" + x[want.end() :])


def test_engines_agree(spark):
    """Random patterns over random values: the JVM, where it may run, finds what RE2 finds."""
    rng, cases = random.Random(5), []
    atoms = ["a", "b", ".", "[ab]", "[^a]", r"\d", r"\s", "1", " ", "(?:a|b)", "(?:ab|b)", "^", "$"]
    while len(cases) < 120:
        p = "".join(rng.choice(atoms) + rng.choice(["", "", "", "*", "+", "?", "{1,2}", "*?"]) for _ in range(rng.randint(1, 4)))
        p = re.sub(r"([\^$])(\*\?|[*+?]|\{1,2\})", r"\1", rng.choice([p, p, f"{p}|b1"]))
        tree = patterns.plain(patterns.read(p))
        if patterns.soon(tree):
            cases.append((p, patterns.written(tree, True), patterns.written(tree, False)))
    values = ["".join(rng.choice("aab1 \n") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", *[F.struct(patterns.found(F.col("v"), p), patterns.replace_first(F.col("v"), p, "_")).alias(f"c{k}") for k, (p, *_) in enumerate(cases)]).collect()
    array = pa.array([r.v for r in got])
    for k, (p, _, re2) in enumerate(cases):
        want = zip(pc.match_substring_regex(array, re2).to_pylist(), pc.replace_substring_regex(array, rf"\A((?s:.*?))(?:{re2})", r"\1_").to_pylist())
        assert [tuple(r[f"c{k}"]) for r in got] == [*want], p


@pytest.mark.parametrize("pattern, yes, no", [("[[:alpha:]]", "x1", "é1"), (r"^\w+$", "aéⅣ_1", "a-b"), (r"x\w*\s\S*z", "xé\u00a0é\u2003z"[:4] + "z", "xé-z"), (r"\p{Greek}", "aβ", "ab"), (r"\u00e9|\x{1F600}", "😀", "e"), ("(?x) a b # c", "ab", "a b"), ("[]a]+", "]", "b"), (r"^[\d_]*\W", "1_-", "1_a"), ("(?i)É", "é", "e")])
def test_unicode(spark, pattern, yes, no):
    df = spark.createDataFrame([(yes,), (no,), (None,)], "v string")
    assert [r[0] for r in df.select(patterns.found(F.col("v"), pattern)).collect()] == [True, False, None]


@pytest.mark.parametrize("bad", [r"\bfoo.*bar\b", r"x[\W_]*y", "x[a-z&&[^b]]*y", "(?:(?:x{900}){900})", "a**", "(?U)a", "(?-u)a", "[a", "(?:a", "a)", r"\<" + "a{2,1}"])
def test_patterns_that_neither_engine_takes(spark, bad):
    with pytest.raises(ConfigurationError):
        patterns.compiled(bad)


@pytest.mark.parametrize("good", ["(a)", "(?:(?:(?:a)))", r"\(\(\(\(", "[((((]", "(?P<year>\\d+)-(?P<m>\\d+)", "a{1,5}"])
def test_patterns_that_pass(spark, good):
    patterns.compiled(good)


def test_rename_swaps_and_is_strict(spark):
    c = ctx(spark, "a string, b string, `x.y` string", ("1", "2", "3"))
    got = ops.rename_column(c, {"a": "b", "b": "a", "x.y": "z"})
    assert got.columns == ["b", "a", "z"] and col(got, "a") == ["2"] and col(got, "z") == ["3"]
    for bad in ({"nope": "x"}, {"a": "b"}):
        with pytest.raises(LogicError):
            ops.rename_column(c, bad)
    with pytest.raises(ConfigurationError):
        ops.rename_column(c, {"a": "q", "b": "q"})


def test_drop_is_strict(spark):
    c = ctx(spark, "a string, `x.y` string", ("1", "2"))
    assert ops.drop_column(c, ["x.y"]).columns == ["a"]
    with pytest.raises(LogicError):
        ops.drop_column(c, ["b"])
    with pytest.raises(ConfigurationError):
        ops.drop_column(c, ["a", "a"])


def test_diacritics(spark):
    assert sum(map(len, PLAIN.values())) + len(WIDE) == 104
    c = ctx(spark, "f string, l string", ("José", "García"), ("Straße", "Łódź"), ("Æon", None), ("ğıůě", "é"))
    got = ops.handle_diacritics(c, ["f", "l"])
    assert col(got, "f") == ["Jose", "Strasse", "AEon", "ğıůě"] and col(got, "l") == ["Garcia", "Lodz", None, "é"]
    extra = ops.handle_diacritics(c, ["f"], "_ascii")
    assert col(extra, "f")[0] == "José" and col(extra, "f_ascii")[0] == "Jose"
    with pytest.raises(LogicError):
        ops.handle_diacritics(extra, ["f"], "_ascii")
    assert ops.handle_diacritics(c, []).columns == c.columns


def test_countries(spark):
    assert len(lookups.countries()) == 211
    values = [("US", "US"), ("GBR", "GB"), (" Germany ", "DE"), ("france", "FR"), ("UNKNOWN", None), ("", None), (None, None), ("UK", "GB"), ("America", "US"), ("Holland", "NL"), ("Brasil", "BR"), ("cote d'ivoire", "CI"), ("Türkiye", None), ("saint kitts and nevis", "KN"), ("São Tomé", None), ("sao tome and principe", "ST"), ("Kosovo", "XK"), ("réunion", None)]
    c = ctx(spark, "c string", *[(v,) for v, _ in values])
    got = ops.iso_country_sanitizer(c, "c", "c")
    assert col(got, "c") == [w for _, w in values]
    got.data.collect()
    (w,) = got.warnings.drain()
    assert w.count == 4 and "UNKNOWN (1x)" in w.detail
    assert col(ops.iso_country_sanitizer(c, "c", "d", "alpha3"), "d")[:4] == ["USA", "GBR", "DEU", "FRA"]
    with pytest.raises(LogicError):
        ops.iso_country_sanitizer(c, "x", "y")
    with pytest.raises(ConfigurationError):
        ops.iso_country_sanitizer(c, "c", "y", "alpha4")


def test_dial_codes(spark):
    codes = lookups.dial_codes()
    assert len(codes) == 422
    assert {k: codes[k] for k in ("gb", "usa", "nz", "kz", "ru", "jm", "ag", "ie", "zw", "xk", "gg", "li", "cw", "mm", "tl")} == {"gb": "44", "usa": "1", "nz": "64", "kz": "7", "ru": "7", "jm": "1876", "ag": "1268", "ie": "353", "zw": "263", "xk": "383", "gg": "44", "li": "423", "cw": "599", "mm": "95", "tl": "670"}


def test_phones(spark):
    rows = [("02102201202", "NZ", None), ("+44 7911 123456", "GB", None), ("(04) 1234-5678", None, "AUS"), ("2025551234", "us", None), ("00215551234", "XX", "NZ"), ("12", None, None), ("n/a", "GB", None), (None, "GB", None)]
    c = ctx(spark, "p string, work string, home string", *rows)
    got = ops.cellphone_sanitizer(c, "p", ["work", "home"], "out")
    assert col(got, "out") == ["+64 2102201202", "+447911123456", "+61 412345678", "+1 2025551234", "+64 0215551234", "12", None, None]
    got.data.collect()
    assert [w.count for w in got.warnings.drain()] == [1]
    with pytest.raises(LogicError):
        ops.cellphone_sanitizer(c, "p", ["x"], "out")
    with pytest.raises(ConfigurationError):
        ops.cellphone_sanitizer(c, "p", [], "out")


def test_plans_stay_in_the_jvm_and_shuffle_once(spark, small):
    c = RosterContext(spark.read.parquet(f"{small}/events.parquet"))
    plan = ops.scd_type_2(c, "user_id", "ts").data._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    c = RosterContext(spark.read.parquet(f"{small}/customer.parquet"))
    got = ops.drop_column(ops.regex_replace(ops.handle_diacritics(c, ["c_name"]), "c_name", "a", "b"), ["c_acctbal", "c_mktsegment"])
    plan = got.data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "c_acctbal" not in plan and "Python" not in plan
    assert F.count("*") is not None
