"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

There are two sets of templates, in the folder ``licenses`` and as a parameter: headers (notices and standard paragraphs) and
whole licence texts.  Headers are compared with every line of a text and with every block (a run of neighbouring lines that
hold a letter or digit of ASCII, so a paragraph of a comment, wrapped as it may be); from ``HEADER_COSINE`` on the file has
that license.  Licence texts are compared with whole texts only; from ``FILE_COSINE`` on, and if its name is not that of a
source file (``FILE_NAME``), the file is a license file: it has that license and declares it for its directory.  A file with
no license of its own takes that of its directory, or else of the nearest ancestor directory that has one.

Terms are lower-case runs of letters and digits of ASCII.  A term weighs (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), where df
counts the texts that hold it among all n texts.

Texts that cannot reach a threshold are left out before their lines are looked at, by proof.  The squared weights of a
template add up to 1.  By Cauchy and Schwarz the squared cosine of a unit is at most the sum over the template's terms that
the unit's text holds; the terms with the least weights, ``REST`` in sum, are taken as held by every text, so that only the
template's characteristic terms are looked up.

Only DataFrame functions are used.  Defined results: a null text counts as empty and has no license of its own; a null path
lies in the directory '' and inherits from there; texts of any length are taken whole; of equal cosines the template listed
first, the earlier line, and a line before the block that it begins count; of equally frequent licenses of a directory's
license files the first in the alphabet counts; repeated rows give repeated rows; an empty table gives none; columns but
those named are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import located, table, text_of, written

HEADER_COSINE, FILE_COSINE, REST = 0.7, 0.8, 0.1
#: Names of license files: the usual ones, those without an extension, and those of plain documents.
FILE_NAME = r"(?i)^([^/]*[._-])?(un)?(licen[sc]e|copying)([._-][^/]*)?$|^[^./]*$|\.(txt|md|rst|html?)$"
#: (license, whether it is a whole text, text).
Template = tuple[str, bool, str]


@lru_cache(maxsize=1)
def default_templates() -> tuple[Template, ...]:
    folder = resources(__package__) / "licenses"
    headers = [line.split("\t") for line in (folder / "headers.tsv").read_text().splitlines()]
    texts = sorted(f.name for f in folder.iterdir() if f.name.endswith(".txt"))
    return (*[(name, False, text) for name, text in headers], *[(f.removesuffix(".txt"), True, (folder / f).read_text()) for f in texts])


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


def terms(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[^a-z0-9]+"), "")


def _idf(df: Column, n: int) -> Column:
    return F.log((1 + n) / (1 + F.coalesce(df, F.lit(0)))) + 1


def _weights(spark: SparkSession, templates: tuple[Template, ...], df: DataFrame, n: int) -> list[dict[str, float]]:
    """The vector of each template, of norm 1.  df: term, df.  As many rows reach the driver as the templates have terms."""
    words = [terms_of(t) for _, _, t in templates]
    own = spark.createDataFrame([(w,) for w in sorted({w for ws in words for w in ws})], "term string")
    idf = {r.term: r.idf for r in df.join(F.broadcast(own), "term", "right").select("term", _idf(F.col("df"), n).alias("idf")).collect()}
    out = []
    for ws in words:
        w = {t: (1 + math.log(ws.count(t))) * idf[t] for t in dict.fromkeys(ws)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def _wide(spark: SparkSession, vectors: list[dict[str, float]]) -> DataFrame:
    """term, and w0, w1, ...: its weight in each template."""
    vocabulary = sorted({t for v in vectors for t in v})
    columns = ", ".join(f"w{k} double" for k in range(len(vectors)))
    return spark.createDataFrame([(t, *[v.get(t, 0.0) for v in vectors]) for t in vocabulary], f"term string, {columns}")


def heavy(vector: dict[str, float]) -> tuple[dict[str, float], float]:
    """The squares of the heaviest weights, and the sum of the other squares, REST at most."""
    out, left = {}, sum(w * w for w in vector.values())
    for t in sorted(vector, key=lambda t: (-vector[t], t)):
        if left <= REST:
            break
        out[t] = vector[t] ** 2
        left -= out[t]
    return out, max(0.0, left)


def _candidates(spark: SparkSession, texts: DataFrame, templates: tuple[Template, ...], vectors: list[dict[str, float]], least: list[float]) -> DataFrame:
    """at, header, whole: texts that may reach the threshold of a header or of a whole text."""
    parts = [heavy(v) for v in vectors]
    held = texts.select("at", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(_wide(spark, [p[0] for p in parts])), "term")
    sums = held.groupBy("at").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(parts))])
    may = [F.col(f"w{k}") + rest >= least[k] ** 2 - 1e-6 for k, (_, rest) in enumerate(parts)]
    any_of = lambda whole: F.array_contains(F.array(F.lit(False), *[m for m, t in zip(may, templates) if t[1] == whole]), True)
    return sums.select("at", any_of(False).alias("header"), any_of(True).alias("whole")).filter("header or whole")


def _units(texts: DataFrame) -> DataFrame:
    """at, kind (0 whole text, 1 line, 2 block), line (of a block its first; of a whole text 0), term and tf; texts: at, text, header, whole."""
    lines = texts.filter("header").select("at", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line") + 1)
    lines = lines.withColumn("none", ~F.col("t").rlike("[A-Za-z0-9]"))
    lines = lines.withColumn("block", F.sum(F.col("none").cast("int")).over(Window.partitionBy("at").orderBy("line"))).filter("not none")
    begins = F.min("line").over(Window.partitionBy("at", "block"))
    longer = F.count("*").over(Window.partitionBy("at", "block")) > 1
    lines = lines.select("at", "line", "t", F.when(longer, begins).alias("begin"))
    one = lines.select("at", F.lit(1).alias("kind"), "line", "t")
    many = lines.filter("begin is not null").select("at", F.lit(2).alias("kind"), F.col("begin").alias("line"), "t")
    whole = texts.filter("whole").select("at", F.lit(0).alias("kind"), F.lit(0).alias("line"), F.col("text").alias("t"))
    rows = one.unionByName(many).unionByName(whole).select("at", "kind", "line", F.explode(terms(F.col("t"))).alias("term"))
    return rows.groupBy("at", "kind", "line", "term").agg(F.count("*").alias("tf"))


def _best(spark: SparkSession, units: DataFrame, templates: tuple[Template, ...], vectors: list[dict[str, float]], df: DataFrame, n: int, least: list[float]) -> DataFrame:
    """at, own (the best header) and whole (the best whole text) of the texts that have one."""
    x = (1 + F.log("tf")) * _idf(F.col("df"), n)
    rows = units.join(df, "term").withColumn("x", x).join(F.broadcast(_wide(spark, vectors)), "term", "left")
    dots = [F.sum(F.col("x") * F.coalesce(F.col(f"w{k}"), F.lit(0.0))).alias(f"d{k}") for k in range(len(vectors))]
    rows = rows.groupBy("at", "kind", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    cosines = [
        F.when((F.col("kind") == 0) == F.lit(whole), F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 9).alias("cosine"), F.lit(-k).alias("k"), F.lit(name).alias("license"), F.lit(least[k]).alias("least")))
        for k, (name, whole, _) in enumerate(templates)
    ]
    rows = rows.select("at", "kind", "line", F.array_max(F.filter(F.array(*cosines), lambda c: c.isNotNull() & (c["cosine"] >= c["least"]))).alias("c")).filter("c is not null")
    best = F.struct(F.col("c.cosine").alias("cosine"), (-F.col("line")).alias("line"), (-F.col("kind")).alias("kind"), F.col("c.license").alias("license"))
    return rows.groupBy("at").agg(F.max(F.when(F.col("kind") > 0, best)).alias("own"), F.max(F.when(F.col("kind") == 0, best)).alias("whole"))


def nearest(places: DataFrame, declared: DataFrame) -> DataFrame:
    """dir and near (depth, up, license) of every directory of places that has a declared license (up, license) at or above."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    chain = places.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    return chain.join(declared, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "license")).alias("near"))


def license_scan(files: DataFrame, path: Column, templates: tuple[Template, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE, file_name: str = FILE_NAME) -> DataFrame:
    """id, path, license, origin (file, line, block, directory or null), cosine and first line of an own license,
    is_license_file, and the directory from which a license is inherited."""
    spark, templates = files.sparkSession, default_templates() if templates is None else templates
    rows = located(files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(path, F.lit("")).alias("path"), text_of(text_col).alias("text")))
    at = rows.select("at", "row.*")
    least = [file_cosine if whole else header_cosine for _, whole, _ in templates]

    df = at.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df, n = written(df, "license-terms"), at.count()
    vectors = _weights(spark, templates, df, n)
    may = written(at.join(_candidates(spark, at, templates, vectors, least), "at").select("at", "text", "header", "whole"), "license-candidates")
    found = written(_best(spark, _units(may), templates, vectors, df, n, least), "licenses")

    slim = at.select("at", "id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).rlike(file_name).alias("named"))
    told = slim.join(found, "at", "left").withColumn("whole", F.when(F.col("named"), F.col("whole")))
    votes = told.filter("whole is not null").groupBy("dir", F.col("whole.license").alias("license")).count()
    first = Window.partitionBy("dir").orderBy(F.desc("count"), "license")  # at most a row for each license of a directory
    declared = votes.withColumn("k", F.row_number().over(first)).filter("k = 1").select(F.col("dir").alias("up"), "license")
    out = told.join(nearest(slim, declared), "dir", "left").withColumn("mine", F.coalesce("whole", "own"))
    has, kinds = F.col("mine").isNotNull(), F.array(*map(F.lit, ("file", "line", "block")))
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("mine.license", "near.license").alias("license"),
        F.when(has, F.element_at(kinds, 1 - F.col("mine.kind"))).when(F.col("near").isNotNull(), "directory").alias("origin"),
        F.col("mine.cosine").alias("cosine"),
        (-F.col("mine.line")).cast("bigint").alias("line"),
        F.col("whole").isNotNull().alias("is_license_file"),
        F.when(~has, F.col("near.up")).alias("inherited_from"),
    )


#: Documents have no paths: their source and language stand for directories.
DOCUMENT_PATH = "concat_ws('/', source, lang, concat(cast(doc_id div 1000 as string), 'k'), concat(cast(doc_id as string), '.txt'))"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), F.expr(DOCUMENT_PATH))


def _sql() -> str:
    templates = default_templates()
    listed = ", ".join(f"({k}, '{name}', {whole}, '{' '.join(terms_of(t))}')" for k, (name, whole, t) in enumerate(templates))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  concat_ws('/', source, lang, (doc_id // 1000) || 'k', doc_id || '.txt') AS path FROM documents),
dirs AS (SELECT r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d),
templates(k, license, whole, words) AS (VALUES {listed}),
tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(string_split(words, ' ')) AS term FROM templates) GROUP BY ALL),
words AS (SELECT DISTINCT r, unnest(regexp_extract_all({low.format('text')}, '[a-z0-9]+')) AS term FROM d),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM words GROUP BY term),
tw AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w
       FROM (SELECT k, term, (1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS x FROM tt LEFT JOIN df USING (term), n)),
split AS (SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM d),
marked AS (SELECT *, NOT regexp_matches(t, '[A-Za-z0-9]') AS none FROM split),
lines AS (SELECT r, line, t, min(line) OVER b AS begin, count(*) OVER b AS size
          FROM (SELECT *, sum(none::INT) OVER (PARTITION BY r ORDER BY line) AS block FROM marked) WHERE NOT none WINDOW b AS (PARTITION BY r, block)),
units AS (SELECT r, 0 AS kind, 0 AS line, text AS t FROM d UNION ALL SELECT r, 1, line, t FROM lines
          UNION ALL SELECT r, 2, begin, t FROM lines WHERE size > 1),
uw AS (SELECT r, kind, line, term, count(*) AS tf FROM (SELECT r, kind, line, unnest(regexp_extract_all({low.format('t')}, '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
uv AS (SELECT r, kind, line, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM uw JOIN df USING (term), n),
norms AS (SELECT r, kind, line, sqrt(sum(x * x)) AS norm FROM uv GROUP BY ALL),
cos AS (SELECT r, kind, line, k, round(sum(x * w) / any_value(norm), 9) AS c FROM uv JOIN tw USING (term) JOIN norms USING (r, kind, line) GROUP BY r, kind, line, k),
good AS (SELECT r, kind, line, c, k, license FROM cos JOIN templates USING (k)
         WHERE (kind = 0) = whole AND c >= CASE WHEN whole THEN {FILE_COSINE} ELSE {HEADER_COSINE} END),
own AS (SELECT r, c, kind, line, license FROM good QUALIFY row_number() OVER (PARTITION BY r ORDER BY least(kind, 1), c DESC, line, kind, k) = 1),
declared AS (SELECT dir, license FROM (SELECT dir, license, count(*) AS n FROM own JOIN dirs USING (r) WHERE kind = 0 GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1),
near AS (SELECT r, declared.dir AS up, license FROM dirs JOIN declared ON declared.dir = dirs.dir OR declared.dir = '' OR starts_with(dirs.dir, declared.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(declared.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, near.license) AS license,
       CASE WHEN own.r IS NOT NULL THEN ['file', 'line', 'block'][own.kind + 1] WHEN near.r IS NOT NULL THEN 'directory' END AS origin,
       own.c AS cosine, own.line::BIGINT AS line, coalesce(own.kind = 0, false) AS is_license_file,
       CASE WHEN own.r IS NULL THEN up END AS inherited_from
FROM dirs LEFT JOIN own USING (r) LEFT JOIN near USING (r)
"""


SQL = _sql()
