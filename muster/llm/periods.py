"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends.  Two
positions of a text are in one class of level l if the l words from them on are the same.  Level l + 1 splits the classes of
level l by the class of the following position.  Only what became small in the last split need be looked at: of the parts of
each split class all but the largest deal out the positions before their members (the smaller halves), so a position is
looked at O(log n) times.  Members of a class are linked in order; a link of length l that is there at level l joins the two
halves of a square with a root of l words.  So when a link goes, the levels of its life tell whether it was one.  Squares of
the same root length that start at neighbouring words make up a run.

All texts of a batch are refined together, level by level, by array operations over what is active in any of them; a text
whose classes have single members has nothing active any more, and level n div ``times`` is a text's last.

Defined results: a null text counts as empty and has no runs; texts of any length are taken whole; words are compared as
they are, byte by byte; repeated rows give repeated rows; an empty table gives none; columns but the two named are not
looked at, whatever their names; a null identifier is one like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import coded, kind, slices, table, text_bytes

#: Words of a run at least, and periods of it at least.
LEAST, TIMES = 24, 3
#: Bytes of texts that are refined together, about.
TOGETHER = 8 << 20


class Classes:
    """Classes of positions with equal factors, over several texts at once.

    ``order`` holds the members of class c from ``start[c]`` on, ``size[c]`` of them; ``place`` is its inverse.  ``after`` and
    ``before`` link the members of a class in order, -1 at its ends, and ``since`` is the level that made the link to the
    member after.  Each text is followed by a place that equals no other, so factors that go beyond it equal none."""

    def __init__(self, words: list[np.ndarray], times: int) -> None:
        counts = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(counts + 1) - (counts + 1)
        n = int((counts + 1).sum())
        self.text = np.repeat(np.arange(len(words)), counts + 1)
        self.last = counts // times
        width = max((int(w.max(initial=-1)) for w in words), default=-1) + 2
        keys = np.full(n, width - 1, np.int64)
        keys[np.arange(n) != (self.begins + counts)[self.text]] = np.concatenate([np.zeros(0, np.int64), *words])
        keys += self.text * width
        self.order = np.argsort(keys, kind="stable")
        in_order = keys[self.order]
        new = np.diff(in_order, prepend=-1) != 0
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.n_classes = int(new.sum())
        self.start, self.size = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        self.start[: self.n_classes] = np.flatnonzero(new)
        self.size[: self.n_classes] = np.bincount(self.of, minlength=self.n_classes)
        self.after, self.before, self.since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        linked = np.flatnonzero(~new)
        self.after[self.order[linked - 1]], self.before[self.order[linked]] = self.order[linked], self.order[linked - 1]
        self.moves = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        # All words but the most frequent of each text; those of single members count too.
        by_text = np.lexsort((-self.size[: self.n_classes], self.text[self.order[self.start[: self.n_classes]]]))
        first = by_text[np.diff(self.text[self.order[self.start[by_text]]], prepend=-1) != 0]
        largest = np.zeros(self.n_classes, bool)
        largest[first] = True
        self.small = np.flatnonzero(~largest[self.of])

    def ended(self, at: np.ndarray, level: int | np.ndarray) -> None:
        """The links from these positions are there up to the level: squares if their length is a level that they have seen."""
        at, level = at[(there := self.after[at] >= 0)], level if np.isscalar(level) else level[there]
        length = self.after[at] - at
        hit = (self.since[at] <= length) & (length <= level)
        self.squares.append((at[hit], length[hit]))

    def refine(self) -> tuple[np.ndarray, np.ndarray]:
        """First positions and root lengths of all squares with primitive roots, up to the last level of each text."""
        level, due = 1, np.sort(self.last)
        while len(self.small):
            if (k := np.searchsorted(due, level, "right")) > np.searchsorted(due, level - 1, "right") or level == 1 and k:
                self.small = self.small[self.last[self.text[self.small]] > level]
            self.split(level)
            level += 1
        everywhere = np.flatnonzero(self.after >= 0)
        self.ended(everywhere, self.last[self.text[everywhere]])
        return tuple(np.concatenate(x) for x in zip(*self.squares))

    def split(self, level: int) -> None:
        """From the classes of this level to those of the next one."""
        at = self.small - 1
        at = at[at >= 0]
        at = at[self.size[self.of[at]] > 1]
        self.small = at[:0]
        if not len(at):
            return
        at = np.sort(at)
        parent, by = self.of[at], self.of[at + 1]
        in_class = np.argsort(parent, kind="stable")  # by class, and in order within
        at, parent, by = at[in_class], parent[in_class], by[in_class]
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        touched = np.diff(np.append(first, len(at)))
        left = self.size[parent[first]] - touched
        # A class that moves as a whole to the same successor isn't split.
        whole = (left == 0) & (np.minimum.reduceat(by, first) == np.maximum.reduceat(by, first))
        if whole.any():
            keep = np.repeat(~whole, touched)
            at, parent, by = at[keep], parent[keep], by[keep]
            touched, left = touched[~whole], left[~whole]
            if not len(at):
                return
            first = np.cumsum(touched) - touched
        olds = parent[first]

        # Links: those of the members that move end, and so do those of the members before them.
        joins = np.append((self.after[at[:-1]] == at[1:]), False)
        heads, tails = at[np.concatenate(([True], ~joins[:-1]))], at[~joins]
        p, q = self.before[heads], self.after[tails]
        self.ended(np.concatenate((at, p[p >= 0])), level)
        self.after[p[p >= 0]], self.since[p[p >= 0]] = q[p >= 0], level + 1
        self.before[q[q >= 0]] = p[q >= 0]

        # Groups: members of a class before the same class.
        deal = np.lexsort((by, parent))
        at, by = at[deal], by[deal]
        opens = (np.diff(parent, prepend=-1) != 0) | (np.diff(by, prepend=-1) != 0)
        begin = np.flatnonzero(opens)
        counts = np.diff(np.append(begin, len(at)))
        group = np.cumsum(opens) - 1
        self.after[at[:-1]] = np.where(opens[1:], -1, at[1:])
        self.before[at[1:]] = np.where(opens[1:], -1, at[:-1])
        self.after[at[-1]] = self.before[at[0]] = -1
        self.since[at] = level + 1

        # Members that move go to the end of their class's places, group after group.
        slots = np.arange(len(at)) + np.repeat(self.start[olds] + left - first, touched)
        self.moves[at] = True
        there = self.order[slots]
        stay = there[~self.moves[there]]
        free = self.place[at]
        free = free[free < np.repeat(self.start[olds] + left, touched)]
        self.order[free], self.place[stay] = stay, free
        self.order[slots], self.place[at] = at, slots
        self.moves[at] = False
        new = self.n_classes + np.arange(len(begin))
        self.n_classes += len(begin)
        self.start[new], self.size[new], self.of[at] = slots[begin], counts, new[group]
        self.size[olds] = left

        # All parts but the largest of each class are small.
        of_group = np.searchsorted(first, begin, "right") - 1
        best = np.maximum.reduceat(counts, np.flatnonzero(np.diff(of_group, prepend=-1)))
        rest_is_largest = left >= best
        order = np.lexsort((-counts, of_group))
        largest = np.zeros(len(begin), bool)
        largest[order[np.diff(of_group[order], prepend=-1) != 0]] = True
        largest &= ~rest_is_largest[of_group]
        small = [at[~largest[group]]]
        rest = np.flatnonzero(~rest_is_largest & (left > 0))
        if len(rest):
            k = left[rest]
            small.append(self.order[np.arange(k.sum()) + np.repeat(self.start[olds[rest]] - (np.cumsum(k) - k), k)])
        self.small = np.concatenate(small)


def runs(words: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text (words as numbers) the rows start, length, period of its runs of ``least`` words and ``times`` periods
    (two at least) or more, by start and period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    classes = Classes(words, times)
    at, period = classes.refine()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(period) != 0)
    first = np.flatnonzero(new)
    start, q = at[first], period[first]
    length = np.diff(np.append(first, len(at))) + 2 * q - 1
    long = length >= np.maximum(least, times * q)
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, start))
    text = classes.text[start[order]]
    rows = np.stack((start[order] - classes.begins[text], length[order], q[order]), 1)
    return np.split(rows, np.searchsorted(text, np.arange(1, len(words))))


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut down to its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """id, n_words, runs (start, length and period of each, in words, by start and period) and collapsed (the bytes of the
    words that no run holds after its first period, joined by one space) of every row.

    ``rewrite`` may change the words of a row, given its identifier, before they are looked at."""
    schema = f"id {kind(docs, id_col)}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, TOGETHER)):
            texts = [t.as_py().split() for t in b.column(1)]
            if rewrite:
                texts = [rewrite(k, t) for k, t in zip(b.column(0).to_pylist(), texts)]
            found = runs([coded(t) for t in texts], least, times)
            collapsed = [b" ".join(t if not len(r) else [t[k] for k in np.flatnonzero(kept(len(t), r)).tolist()]) for t, r in zip(texts, found)]
            flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)], dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in flat.T], fields=list(out.field("runs").type.value_type)), type=out.field("runs").type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field("id").type), pa.array([len(t) for t in texts], pa.int64()), rows, pa.array(collapsed, pa.binary())], schema=out)

    return docs.select(F.col(f"`{id_col}`").alias("k"), text_bytes(text_col).alias("t")).mapInArrow(run, schema)


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The query's rewriting: a tenth of the texts, by their identifiers, repeat a stretch of words up to their end; those
    without an identifier stay as they are."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // len(stretch))))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of what is left of the text."""
    got = periodic_runs(docs, rewrite=planted)
    # Runs come by start and period, so the first of equals stays.
    best = F.expr("reduce(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (m, r) -> if(m IS NULL OR r.length * m.period > m.length * r.period, r, m))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    got = got.withColumn("best", best)
    return got.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
