"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Word 1- and 2-grams are hashed to ``BUCKETS`` buckets.  Two multinomials over the buckets, of the trusted documents
and of all documents, give each bucket the weight ln p_target - ln p_raw.  The raw counts are scaled to the size of the
target before both are smoothed by ``PRIOR``, so a bucket with little evidence has a weight near 0.  A document's score
is the mean weight of its n-grams, and it is kept when the score is at least ``LEAST``.  Weights are whole micro-nats, so
that sums are exact and do not depend on the order of rows.

Only the buckets of n-grams are hashed, as the method says.  Words are compared as they are: a text's words are numbered
in the order in which they come up, and repeated windows are found over these numbers.

Defined results: a null text counts as empty (no words, base_failed); bytes that aren't UTF-8 count as U+FFFD in word_chars; texts of any length are taken whole; a document
without n-grams has score 0; a score equal to ``LEAST`` keeps; labels that repeat, or name no document, or have a null
identifier or quality, change nothing; with no trusted documents all scores are 0; repeated rows give repeated rows; an
empty table gives none.  ``keep_good`` carries all columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded, kind, map_texts, slices, table, text_bytes

#: LEAST lies in the gap that five-fold cross-validation leaves on labelled documents: those of quality 1 score -0.04 at least
#: when the fold's own labels are left out, those of quality 0 that pass the base rules -0.11 at most.
BUCKETS, PRIOR, LEAST, MICRO = 1 << 16, 16, -0.075, 1_000_000
#: Bytes of labels' identifiers that may be broadcast; words whose hashes a worker remembers.
MOST_BROADCAST, REMEMBERED = 32 << 20, 1 << 17
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


class Hashes(dict):
    """The first 32 bits of a word's MD5, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")
        return h


HASHES = Hashes()


def buckets(words: list[bytes]) -> np.ndarray:
    """Of the 1-grams and then the 2-grams of these words."""
    h = np.fromiter(map(HASHES.__getitem__, words), np.int64, len(words))
    return np.concatenate((h % BUCKETS, (h[:-1] * 1000003 + h[1:] + 1) % BUCKETS))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    if len(words) < 4:
        return 0
    codes = defaultdict(count().__next__)
    w = coded(words, codes)
    if len(codes) == len(words):  # no word comes up twice
        return 0
    pair = np.unique(w[:-1] * len(codes) + w[1:], return_inverse=True)[1].astype(np.int64)
    window = np.unique(pair[:-1] * len(codes) + w[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(len(w), bool)
    at = np.flatnonzero(window[2][window[1]] > 1)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text.translate(None, SPACE).decode(errors="replace")), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words)


def with_trusted(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """t (bytes of the text) and trusted (whether the labels give its document quality 1) of every row of docs.

    The labels' identifiers are broadcast only if they are few bytes."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct()
    size = good.agg(F.coalesce(F.sum(F.octet_length(F.col("good").cast("string")) + 16), F.lit(0))).first()[0]
    good = F.broadcast(good) if size <= most_broadcast else good.hint("merge")
    rows = docs.select(F.col("doc_id").alias("k"), text_bytes().alias("t"))
    return rows.join(good, rows["k"] == good["good"], "left").select("t", F.col("good").isNotNull().alias("trusted"))


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Micro-nats of each bucket.  Each task counts its rows; Spark adds the counts; BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for part in slices(b, 0):
                own = [buckets(t.split()) for t in part.column(0).to_pylist()]
                total[0] += np.bincount(np.concatenate(own), minlength=BUCKETS)
                if good := [x for x, trusted in zip(own, part.column(1).to_pylist()) if trusted]:
                    total[1] += np.bincount(np.concatenate(good), minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["b", "raw", "target"])

    found = with_trusted(docs, labels).mapInArrow(run, "b bigint, raw bigint, target bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():
        raw[r.b], target[r.b] = r.raw, r.target
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    return np.rint(MICRO * np.log((target + PRIOR) / (raw * target.sum() / max(1, raw.sum()) + PRIOR))).astype(np.int64)


def judged(text: bytes, weight: np.ndarray) -> tuple:
    """The counts, base_failed, kept, the sum of the weights in micro-nats and the number of n-grams."""
    words = text.split()
    n, chars, symbols, dup, repeated = counts(text, words)
    at = buckets(words)
    total = int(weight[at].sum())
    failed = n < 50 or 100 * repeated > 50 * n
    return n, chars, symbols, dup, repeated, failed, not failed and total >= LEAST * MICRO * len(at), total, len(at)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_micro", "n_grams")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, llr_micro and n_grams for every row of docs."""
    weight = weights(docs, labels)

    def run(ids: list, texts: list) -> dict:
        rows = [judged(t, weight) for t in texts]
        return {"doc_id": ids} | {name: [r[k] for r in rows] for k, name in enumerate(NAMES)}

    kinds = ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'bigint'}" for n in NAMES)
    return map_texts(docs, run, f"doc_id {kind(docs, 'doc_id')}, {kinds}")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were."""
    weight = weights(docs, labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([judged(t, weight)[6] for t in texts], dtype=bool)

    return docs.filter(good(text_bytes()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
hashed AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT word FROM each)),
seq AS (SELECT r, i, word, h,
               lead(h) OVER p AS h2, lead(word) OVER p AS word2, lead(word, 2) OVER p AS word3
        FROM each JOIN hashed USING (word) WINDOW p AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, h % {BUCKETS} AS b FROM seq
          UNION ALL SELECT r, (h * 1000003 + h2 + 1) % {BUCKETS} FROM seq WHERE h2 IS NOT NULL),
good AS (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
bucket AS (SELECT b, count(*) AS raw, count(good.r) AS target FROM grams LEFT JOIN good USING (r) GROUP BY b),
total AS (SELECT sum(raw) AS raw, sum(target) AS target FROM bucket),
weight AS (SELECT b, round({MICRO} * ln((bucket.target + {PRIOR}) / (bucket.raw::DOUBLE * total.target / total.raw + {PRIOR})))::BIGINT AS m
           FROM bucket, total),
score AS (SELECT r, sum(m)::BIGINT AS llr_micro, count(*) AS n_grams FROM grams JOIN weight USING (b) GROUP BY r),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, word2, word3) AS n FROM seq WHERE word3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) WHERE n > 1 GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, (count(*) - count(DISTINCT line)) AS n FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(llr_micro, 0)::BIGINT AS llr_micro, coalesce(n_grams, 0)::BIGINT AS n_grams
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN score USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr_micro >= {LEAST * MICRO} * n_grams AS kept,
       llr_micro, n_grams
FROM base
"""
