"""Token counts of sections or fields by offsets.

A document is encoded once, as a whole, by the library.  Its tokens' character spans are joined with the spans of its sections; a token
that crosses a boundary is allocated by a rule: ``first`` (the section of its first character), ``last`` (of its last)
or ``most`` (the section with most of its characters, the earlier of two equals).  So the counts of the sections add up
to the document's.  A token that holds only part of a character's bytes spans that whole character.

Defined results: a null text counts as empty and has one empty section without tokens; a null field counts as empty;
bytes that aren't UTF-8 count as U+FFFD; texts of any length are taken whole; repeated rows give repeated rows; an empty table gives none; columns but those
named are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import kind, slices, table, text_bytes, text_of

RULES = ("first", "last", "most")
#: What stands between fields that are joined into one text; it belongs to the field before.
BETWEEN = "\n"


def line_starts(text: bytes) -> np.ndarray:
    """Bytes at which lines start; a line feed belongs to the line that it ends, and none follows the last."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate(([0], at[at < len(text)]))


def spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character of tokens that have these lengths in bytes, and the character at which each byte lies."""
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1], char


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of sorted token spans with sections that start at the characters ``starts``: the section of each
    token, and whether it crosses a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    lo, hi = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "right") - 1
    own, cross = (hi if rule == "last" else lo).copy(), lo != hi
    if rule == "most":
        for k in np.flatnonzero(cross):
            cuts = np.concatenate(([first[k]], starts[lo[k] + 1 : hi[k] + 1], [last[k] + 1]))
            own[k] = lo[k] + int(np.argmax(np.diff(cuts)))
    return own, cross


def _utf8(c: Column) -> Column:
    """Text whose bytes that aren't UTF-8 are replaced."""
    return F.make_valid_utf8(c.cast("string"))


def _counted(rows: DataFrame, starts_of: Callable, ranks_path: str, pattern: str, rule: str, key: str, stable: str | None) -> DataFrame:
    """rows: k, t (bytes) and perhaps more for starts_of(text, *more), which gives the bytes at which sections start."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    tokenizer(ranks_path, pattern, stable)  # mistakes show here, not in a task
    key = f"{key}_id" if key in ("section", "char_start", "char_end", "n_tokens", "n_crossing") else key
    names = [key, "section", "char_start", "char_end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_path, pattern, stable)
        size = np.array([len(x) for x in t.bytes_of], np.int64)
        for b in (part for whole in batches for part in slices(whole, 1)):
            which, cols = [], [[] for _ in range(5)]
            for row, (text, *more) in enumerate(zip(*[c.to_pylist() for c in b.columns[1:]])):
                begin = starts_of(text, *more)
                ids = t.whole.encode_ordinary(text.decode())
                first, last, char = spans(text, size[ids]) if text else (np.zeros(0, np.int64),) * 3
                stop = np.append(char, char[-1] + 1 if len(char) else 0)  # characters before each byte
                starts = stop[begin]
                own, cross = allocate(first, last, starts, rule)
                which.append(np.full(len(begin), row))
                ends = np.append(starts[1:], stop[-1])
                for out, x in zip(cols, (np.arange(len(begin)), starts, ends, np.bincount(own, minlength=len(begin)), np.bincount(own[cross], minlength=len(begin)))):
                    out.append(x)
            keys = b.column(0).take(pa.array(np.concatenate(which)))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.concatenate(x).astype(np.int64)) for x in cols]], names=names)

    return rows.mapInArrow(run, f"`{key}` {kind(rows, 'k')}, section bigint, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint")


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, starts_of: Callable[[bytes], np.ndarray] = line_starts, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", stable: str | None = None) -> DataFrame:
    """One row for each section of each text: id (under its own name, with ``_id`` if another column has that), section (from 0), char_start, char_end, n_tokens, n_crossing (those of
    n_tokens that cross a boundary)."""
    return _counted(docs.select(F.col(f"`{id_col}`").alias("k"), _utf8(text_bytes(text_col)).cast("binary").alias("t")), starts_of, ranks_path, pattern, rule, id_col, stable)


def field_tokens(rows: DataFrame, fields: list[str], ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", stable: str | None = None) -> DataFrame:
    """The same for fields of a row, encoded as one text with ``BETWEEN`` after each but the last."""
    parts = [_utf8(text_of(c)) for c in fields]
    sizes = F.array(*[F.octet_length(p) + len(BETWEEN) for p in parts])

    def starts_of(text: bytes, lengths: list[int]) -> np.ndarray:
        return np.minimum(np.cumsum([0, *lengths[:-1]]), len(text))

    return _counted(rows.select(F.col(f"`{id_col}`").alias("k"), F.concat_ws(BETWEEN, *parts).cast("binary").alias("t"), sizes), starts_of, ranks_path, pattern, rule, id_col, stable)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
