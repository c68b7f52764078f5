"""URL filters: host and path rules, and a weighted vocabulary for the rest.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased URL in one pass.  A hit counts when no letter
or digit of ASCII stands before or after it.  The weights of distinct terms add up, and a URL is blocked from ``LIMIT`` on:
so by one strict term, which weighs ``LIMIT``, or by several distinct soft ones, which weigh less.

Rules of hosts and paths come first: a rule fits its host and all subdomains of it when the path starts with the rule's
path; the longest (host and path together) wins, of equally long ones that with the longer host.

Defined results: a null URL, or one without ``://``, has an empty host and path, so no rule fits it; a null URL has no
hits and is allowed; URLs of any length are taken whole; of several rules with the same host and path the last counts; of a
term's several weights the greatest; repeated rows give repeated rows; an empty table gives none; columns but the identifier
and the URL are not looked at, whatever their names.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from importlib import resources

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

LIMIT = 2.0
#: Bytes of a vocabulary's terms at most: every task gets them.
MOST_VOCABULARY = 8 << 20


def vocabulary_file(name: str = "url_terms.csv") -> dict[str, float]:
    """A table of terms and weights beside this module; its first lines tell where it comes from."""
    lines = resources.files(__package__).joinpath("vocabulary", name).read_text("utf-8").splitlines()
    return {r["term"]: float(r["weight"]) for r in csv.DictReader(x for x in lines if not x.startswith("#"))}


VOCABULARY = vocabulary_file()
#: (host, path, verdict) of the production query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=4)
def automaton(vocabulary: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in vocabulary:
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def hits(url: str, vocabulary: tuple[tuple[str, float], ...]) -> tuple[int, int, float]:
    """Distinct strict and soft terms of a lower-cased URL that stand between boundaries, and the sum of their weights."""
    inside = lambda c: c.isascii() and c.isalnum()
    found = {v for end, v in automaton(vocabulary).iter(url) if not (end + 1 < len(url) and inside(url[end + 1])) and not (end >= len(v[0]) and inside(url[end - len(v[0])]))}
    strict = sum(w >= LIMIT for _, w in found)
    return strict, len(found) - strict, sum(sorted(w for _, w in found))


def lower(c: Column) -> Column:
    return F.translate(c, *LOWER)


def listed(vocabulary: dict[str, float] | DataFrame, most_bytes: int = MOST_VOCABULARY) -> tuple[tuple[str, float], ...]:
    """Terms in order, lower-cased, with their weights.  A vocabulary is made by hand, so it fits in a task; its table is measured
    before it is read, and one of more than ``most_bytes`` is a ValueError."""
    if isinstance(vocabulary, DataFrame):
        terms = vocabulary.select("term", "weight").filter("term is not null and weight is not null")
        size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
        rows = [(r["term"], r["weight"]) for r in terms.collect()] if size <= most_bytes else []
    else:
        rows = [*vocabulary.items()]
        size = sum(len(t.encode()) + 16 for t, _ in rows)
    if size > most_bytes:
        raise ValueError(f"the vocabulary has {size} bytes; tasks take {most_bytes} at most")
    out: dict[str, float] = {}
    for term, weight in rows:
        term = "".join(c.lower() if c.isascii() else c for c in term)
        if term:
            out[term] = max(float(weight), out.get(term, 0.0))
    return tuple(sorted(out.items()))


def url_filter(pages: DataFrame, rules: tuple = RULES, vocabulary: dict[str, float] | DataFrame = VOCABULARY, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft and weight for every row of pages."""
    terms = listed(vocabulary)

    @F.pandas_udf("n_strict bigint, n_soft bigint, weight double")
    def counted(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(u, terms) if terms else (0, 0, 0.0) for u in urls], columns=["n_strict", "n_soft", "weight"])

    url = text_of(url_col)
    host, path = lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), counted(lower(url)).alias("hits"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("hits.weight") >= LIMIT, "block").otherwise("allow")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest is put on last, so it is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "hits.n_strict", "hits.n_soft", "hits.weight")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _sql() -> str:
    terms = ", ".join(f"('{t}', {w})" for t, w in listed(VOCABULARY))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
parts AS (SELECT r, page_id, translate(url, '{LOWER[0]}', '{LOWER[1]}') AS low,
                 translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{LOWER[0]}', '{LOWER[1]}') AS host,
                 regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
terms(term, w) AS (VALUES {terms}),
hit AS (SELECT r, count(*) FILTER (w >= {LIMIT}) AS n_strict, count(*) FILTER (w < {LIMIT}) AS n_soft, sum(w)::DOUBLE AS weight
        FROM parts JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY r),
rules(h, p, v) AS (VALUES {rules}),
best AS (SELECT r, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::BIGINT AS n_strict, coalesce(n_soft, 0)::BIGINT AS n_soft, coalesce(weight, 0)::DOUBLE AS weight
FROM parts LEFT JOIN hit USING (r) LEFT JOIN best USING (r)
"""


SQL = _sql()
