"""Hierarchical Pitman-Yor language model of word triples.

Every pair of words seen in training has a restaurant, whose customers of a dish (a word) are its occurrences after that
pair.  Every table there is a customer of the restaurant of the pair's last word; every table of that one is a customer of
the root, whose own new tables draw from 1 / (V + 1) for each of the V known words and for any unknown one.  No context is
folded, however rare.  Seating is sampled by Gibbs: all customers of a dish leave, and the number of tables at which they sit
down again is drawn given all others; customers sit at a table of size s with weight s - discount and at a new one with
weight (strength + discount * tables) times the parent's probability.  Predictive probabilities are averaged over samples.

How it runs on Spark.  Texts are cut into words once, in chunks of bounded size: a row of packed arrays instead of a row for
each token.  Words get numbers by their hash's part of the vocabulary, where they are compared as they are.  A chunk sends its distinct triples with their counts to buckets by
the middle word, so the restaurants of a word and of all pairs that end in it are one bucket's, and a common triple costs one
entry for each chunk.  Where a word (or the start of texts) has more than ``BUCKET_TOKENS`` occurrences, the dishes of its
restaurant and of those of its pairs are dealt to several buckets by the dish.  They stay one restaurant each: after a round
buckets add up, by pair, the customers and tables that each has, and in the next one each knows all customers and takes the tables
of the others as they were.  The model is thus the same whatever the size of the table; a table of any size has one restaurant
for a context, and one discount and strength for a level.  What remains common to
buckets besides is the root.  A first round samples each bucket
with a root and parts of restaurants of its own and sends the root's customers to buckets by word, where the root is sampled; what it says of each word
goes back, and a second round samples again and answers the chunks' triples.  Within a round a bucket sees the root change by
its own customers only, which is the usual approximation of distributed Gibbs sampling; predictions use a root and restaurants with exact
numbers of customers, so probabilities add up to 1 but for tables that others have moved since.  Rounds are repeated from their seeds rather than stored, and all that is drawn depends on words and counts alone: the
same table gives the same scores however it is partitioned, equal texts get equal scores, and a lost executor changes nothing.

Within a scan a bucket's dishes are drawn in ``TURNS`` turns dealt anew.  Dishes of up to ``SMALL`` customers draw their tables
outright, larger ones by Metropolis steps that keep the same distribution, with proposals from all over it, so they do not
creep away from where they were.  The start is one table for each dish of a restaurant.  Discounts are n1 / (n1 + 2 n2) of a level's
counts, strengths those of ``GRID`` that make the seating likeliest after a scan of the first round (where parts of a restaurant
count as several); buckets send what both follow from along with the root's customers, and use their own in the first round (the root's strength is 1).

Defined results: a null text counts as empty and has one token, the end; a null identifier is not held out; repeated
rows are repeated in training and in the result; texts of any length are taken whole; words are compared as they are; with no
training texts every word has probability 1 / (V + 1) = 1; an empty table gives no rows; columns but doc_id and text are not
looked at, whatever their names.  Scores are sums of logarithms rounded to 1e-6 for each token.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import coded, discard, free_shuffles, kind, slices, table, text_bytes, written, written_at

FOLDS, HELD = 7, 2
ROUNDS, SCANS, SAMPLES, SEED = 2, 2, 2, 17
#: Bytes of text in a chunk, about; more mean fewer triples that several chunks send.
CHUNK_BYTES = 8 << 20
#: Tokens of a bucket, about; tokens whose words are numbered together and sampled together in the root, about.
BUCKET_TOKENS, PART_TOKENS = 1_000_000, 1 << 21
#: Numbers of what is no known word; those of words are larger, and odd if the word was seen once.
START, UNKNOWN, FIRST = 0, 2, 4
#: The word before, in what buckets tell each other of a whole word's restaurant instead of one of its pairs'; it is no word.
WHOLE = 1
#: Dishes of up to so many customers draw their tables outright; Metropolis steps of larger ones; turns of a scan.
SMALL, STEPS, TURNS = 256, 3, 8
GRID = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
MICRO = 1_000_000


def packed(a: np.ndarray, delta: bool = False) -> bytes:
    """Whole numbers, as differences if they mostly rise; byte planes (all first bytes, all second bytes, ...) compress well."""
    a = np.asarray(a, np.int64)
    a = np.diff(a, prepend=0) if delta else a
    a = (a << 1) ^ (a >> 63)  # small numbers of either sign are small
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 3)


def unpacked(b: bytes, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    a = np.zeros((raw.shape[1], 8), np.uint8)
    a[:, : b[0]] = raw.T
    a = a.view(np.int64).ravel()
    a = (a >> 1) ^ -(a & 1)
    return np.cumsum(a) if delta else a


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """f(row as a dict) gives rows as dicts."""
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for row in f({n: c[k] for n, c in zip(b.schema.names, b.columns)}):
                    yield pa.RecordBatch.from_pylist([row], out)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def chunks(docs: DataFrame) -> DataFrame:
    """A row for about CHUNK_BYTES of documents: their identifiers, whether they are held out, their numbers of tokens, the
    chunk's distinct words (the end of a text is the empty word) with their counts in training, and the texts as places in
    these words."""
    schema = f"chunk bigint, ids array<{kind(docs, 'doc_id')}>, held array<boolean>, sizes binary, words binary, n_tokens bigint, counts binary, seq binary"
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2, CHUNK_BYTES)):
            codes = defaultdict(count().__next__)
            end = codes[b""]
            texts = [np.append(coded(t.as_py().lower().split(), codes), end) for t in b.column(2)]
            sizes, seq = np.array([len(t) for t in texts]), np.concatenate(texts)
            del texts
            train = np.repeat(~b.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
            counts = np.bincount(seq[train], minlength=len(codes))
            row = [uuid.uuid4().int >> 65, b.column(0).to_pylist(), b.column(1).to_pylist(), packed(sizes), zstandard.compress(b"\n".join(codes), 3), len(seq), packed(counts), packed(seq)]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out)], schema=out)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), text_bytes().alias("t")).mapInArrow(run, schema)


WORDS = "part bigint, chunk bigint, words binary, counts binary"
NUMBERS = "part bigint, chunk bigint, numbers binary, n binary, total bigint, known bigint, once bigint, hot array<struct<id:bigint,n:bigint>>"


def by_hash(row: dict, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a chunk, their places in order of the part that their hash names, and where each part begins."""
    words = zstandard.decompress(row["words"].as_py()).split(b"\n")
    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    order = np.argsort(part, kind="stable")
    return words, order, np.searchsorted(part[order], np.arange(parts + 1))


def to_parts(row: dict, parts: int) -> Iterator[dict]:
    words, order, begins = by_hash(row, parts)
    counts = unpacked(row["counts"].as_py())
    for p in np.flatnonzero(np.diff(begins)).tolist():
        at = order[begins[p] : begins[p + 1]]
        yield {"part": p, "chunk": row["chunk"].as_py(), "words": zstandard.compress(b"\n".join([words[k] for k in at.tolist()]), 3), "counts": packed(counts[at])}


def numbered(rows: pa.Table, parts: int, bucket_tokens: int, schema: pa.Schema) -> pa.Table:
    """For each chunk the numbers of its words of a part, and how often each was seen in training.

    Numbers are even from FIRST on, small for frequent words, plus 1 for words that were seen once.  The first row tells the
    part's tokens, known words, words seen once, and words with more tokens than a bucket."""
    codes = defaultdict(count().__next__)
    at = [coded(zstandard.decompress(w).split(b"\n"), codes) for w in rows["words"].to_pylist()]
    n = np.bincount(np.concatenate(at), np.concatenate([unpacked(c) for c in rows["counts"].to_pylist()]), len(codes)).astype(np.int64)
    words, p = list(codes), rows["part"][0].as_py()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))  # so they do not depend on the order of rows
    number = np.empty(len(words), np.int64)
    number[order] = FIRST + 2 * (np.arange(len(words)) * parts + p)
    number = np.where(n > 0, number + (n == 1), UNKNOWN)
    hot = [{"id": int(number[k]), "n": int(n[k])} for k in np.flatnonzero(n > bucket_tokens)]
    told = {"total": int(n.sum()), "known": int((n > 0).sum()), "once": int((n == 1).sum()), "hot": hot}
    out = [{"part": p, "chunk": c, "numbers": packed(number[x]), "n": packed(n[x])} for c, x in zip(rows["chunk"].to_pylist(), at)]
    return pa.Table.from_pylist([out[0] | told, *out[1:]], schema)


TEXTS = "chunk bigint, ids array<{}>, held array<boolean>, sizes binary, seq binary, words binary, n_known array<bigint>, base array<double>"


def with_numbers(left: pa.Table, right: pa.Table, parts: int, n: int, v: int, schema: pa.Schema) -> pa.Table:
    """A chunk with the numbers of its words, and what each text's known words and base score are."""
    row, right = {c: left[c][0] for c in left.column_names}, right.sort_by("part")
    words, order, _ = by_hash(row, parts)
    ids, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    ids[order] = np.concatenate([unpacked(x) for x in right["numbers"].to_pylist()])
    counts[order] = np.concatenate([unpacked(x) for x in right["n"].to_pylist()])
    sizes, seq = unpacked(row["sizes"].as_py()), unpacked(row["seq"].as_py())
    at = np.cumsum(sizes) - sizes
    base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1))[seq], at)
    known = np.add.reduceat((counts > 0).astype(np.int64)[seq], at)
    return pa.Table.from_pylist([{x: row[x].as_py() for x in ("chunk", "ids", "held", "sizes", "seq")} | {"words": packed(ids), "n_known": known, "base": base}], schema)


class Triples:
    """The distinct (middle word, word before, word) triples of a chunk; where: the triple of each token."""

    def __init__(self, row: dict, hot: dict[int, int], buckets: int) -> None:
        self.sizes = unpacked(row["sizes"].as_py())
        ids = np.append(unpacked(row["words"].as_py()), START)
        names, local = np.unique(ids, return_inverse=True)  # unknown words are one
        w = local[unpacked(row["seq"].as_py())]
        first = np.cumsum(self.sizes) - self.sizes
        v = np.append(local[-1], w[:-1])
        v[first] = local[-1]
        u = np.append(local[-1], v[:-1])
        u[first] = local[-1]
        size = len(names)
        pair, of = np.unique(v * size + u, return_inverse=True)
        keys, self.where = np.unique(of * size + w, return_inverse=True)
        pair, self.w = pair[keys // size], names[keys % size]
        self.v, self.u = names[pair // size], names[pair % size]
        cut = np.array([hot.get(x, 1) for x in names.tolist()])[pair // size]
        self.bucket = mixed(self.v * 1_000_003 + mixed(self.w) % cut) % buckets

    def sent(self, chunk: int, train: np.ndarray) -> Iterator[dict]:
        """A row for each bucket: triples in order, with their counts in training."""
        counts = np.bincount(self.where[train], minlength=len(self.w))
        order = np.argsort(self.bucket, kind="stable")
        b = self.bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
        for lo, hi in zip(cuts, cuts[1:]):
            at = order[lo:hi]
            yield {
                "bucket": int(b[lo]), "chunk": chunk, "v": packed(self.v[at], True), "u": packed(self.u[at], True), "w": packed(self.w[at]), "c": packed(counts[at]),
            }


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers dealt evenly, below 2**31."""
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (y >> np.uint64(33)).astype(np.int64)


SENT = "bucket bigint, chunk bigint, v binary, u binary, w binary, c binary"


class Seating:
    """Table sizes of many dishes; those of dish i lie at start[i] and after it, tables[i] of them.  Customers move one by
    one: tests hold ``draw_tables`` against it."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        self.discount, self.rng = discount, rng
        self.customers, self.tables = customers.astype(np.int64), (customers > 0).astype(np.int64)
        self.room = np.full(len(customers), 2)
        self.start = np.cumsum(self.room) - self.room
        self.size = np.zeros(int(self.room.sum()), np.int64)
        self.size[self.start] = self.customers

    def leave(self, i: np.ndarray) -> np.ndarray:
        """A random customer of each dish i leaves; whether its table has closed."""
        upto = np.cumsum(self.size)
        low = upto[self.start[i]] - self.size[self.start[i]]
        at = np.searchsorted(upto, low + (self.rng.random(len(i)) * self.customers[i]).astype(np.int64), "right")
        self.size[at] -= 1
        self.customers[i] -= 1
        closed = self.size[at] == 0
        j, at = i[closed], at[closed]
        last = self.start[j] + self.tables[j] - 1  # the last table takes the place of the one that has closed
        self.size[at] = self.size[last]
        self.size[last] = 0
        self.tables[j] -= 1
        return closed

    def sit(self, i: np.ndarray, new_weight: np.ndarray) -> np.ndarray:
        """A customer of each dish i sits down; whether at a new table."""
        old_weight = self.customers[i] - self.discount * self.tables[i]
        u = self.rng.random(len(i)) * (old_weight + new_weight)
        opens = (u >= old_weight) | (self.tables[i] == 0)
        j = i[opens]
        if (full := j[self.tables[j] == self.room[j]]).size:
            self._grow(full)
        self.size[self.start[j] + self.tables[j]] = 1
        self.tables[j] += 1
        self.customers[j] += 1
        j, u = i[~opens], u[~opens]
        if len(j):
            weight = np.where(self.size > 0, self.size - self.discount, 0.0)
            weight[self.start[i[opens]] + self.tables[i[opens]] - 1] = 0.0
            upto = np.cumsum(weight)
            at = np.searchsorted(upto, upto[self.start[j]] - weight[self.start[j]] + u, "right")
            at = np.clip(at, self.start[j], self.start[j] + self.tables[j] - 1)  # against rounding
            self.size[at] += 1
            self.customers[j] += 1
        return opens

    def _grow(self, i: np.ndarray) -> None:
        room = self.room.copy()
        room[i] *= 2
        start = np.cumsum(room) - room
        size = np.zeros(int(room.sum()), np.int64)
        old = np.arange(len(self.size))
        size[old + np.repeat(start - self.start, self.room)] = self.size
        self.room, self.start, self.size = room, start, size


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.asarray(x, np.float64)
    shift = np.zeros(x.shape)
    while (low := x < 10).any():
        shift += np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


@lru_cache(maxsize=4)
def small_stirling(discount: float) -> np.ndarray:
    """Logarithms of the weights of all seatings of c <= SMALL customers at t tables, by recursion."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, SMALL + 1)
    for c in range(SMALL):
        with np.errstate(divide="ignore", invalid="ignore"):
            stays = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isneginf(out[c, 1:]), -np.inf, out[c, 1:] + stays))
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers: the coefficient of x ** c in (1 - (1 - x) ** d) ** t, by an integral over a parabola
    around the cut, through the saddle, times c! / (t! d ** t)."""
    log_v = saddle(c, t, d)
    v = np.maximum(np.exp(log_v), 4 / c)  # further left than 4 / c the integrand would not fall off
    p = v**d
    bend = -t * d * p * ((d - 1) * (1 - p) - d * p) / (v * (1 - p)) ** 2 + (c + 1) / (1 - v) ** 2
    h = np.minimum(0.075, 0.2 / (2 * v * np.sqrt(np.maximum(bend, 1e-300))))
    turn = 1 + 1j * h[:, None] * np.arange(48)
    path = t[:, None] * np.log1p(-p[:, None] * turn ** (2 * d)) - (c + 1)[:, None] * np.log1p(-v[:, None] * turn**2)
    top = path[:, 0].real
    each = (np.exp(path - top[:, None]) * turn).real
    log_coefficient = top + np.log(np.maximum(each.sum(1) - each[:, 0] / 2, 1e-300) * h * 2 * v / np.pi)
    if (near := np.flatnonzero(c - t < 128)).size:  # nearly a pole: a circle
        k, r = (c - t)[near], np.maximum(-np.expm1(log_v[near]), 1e-3)
        y = r[:, None] * np.exp(1j * np.pi * (np.arange(192) + 0.5) / 192)
        path = t[near][:, None] * np.log(-np.expm1(d * np.log1p(-y)) / y) - 1j * k[:, None] * np.angle(y)
        top = path.real.max(1)
        log_coefficient[near] = top + np.log(np.maximum(np.exp(path - top[:, None]).real.mean(1), 1e-300)) - k * np.log(r)
    return log_coefficient + log_gamma(c + 1.0) - log_gamma(t + 1.0) - t * np.log(d)


def log_tables_at(log_v: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """The logarithm of the number of tables of which exp(log_v) is the saddle."""
    return np.log(c + 1) + np.log(-np.expm1(d * log_v)) + (1 - d) * log_v - np.log(d) - np.log(-np.expm1(log_v))


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high, log_t = np.full(len(c), -600.0), np.full(len(c), -1e-13), np.log(t)
    for _ in range(50):
        mid = (low + high) / 2
        few = log_tables_at(mid, c, d) < log_t
        low, high = np.where(few, mid, low), np.where(few, high, mid)
    return (low + high) / 2


def draw_tables(c: np.ndarray, now: np.ndarray, rule: Rule, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, all of whom leave and sit again: t of them with a chance proportional to the
    seatings' weight times the rule's.  Drawn outright for up to SMALL customers, else by STEPS Metropolis steps from now,
    whose proposals do not depend on now."""
    out = now.copy()
    small, stirling = np.flatnonzero((c <= SMALL) & (c > 1)), small_stirling(rule.d)
    ends = np.cumsum(c[small])
    for part in np.split(small, np.flatnonzero(np.diff(ends // 500_000)) + 1):
        if not len(part):
            continue
        n = c[part]
        start = np.cumsum(n) - n
        which = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(which)) - start[which] + 1
        grown = np.cumsum(rule.at(part).step(which, t - 1))
        logs = stirling[n[which], t] + grown - (grown[start] - rule.at(part).step(np.arange(len(n)), np.zeros(len(n), np.int64)))[which]
        upto = np.cumsum(np.exp(logs - np.maximum.reduceat(logs, start)[which]))
        before = np.where(start > 0, upto[start - 1], 0.0)
        at = np.searchsorted(upto, before + rng.random(len(part)) * (upto[start + n - 1] - before), "right")
        out[part] = np.clip(at - start, 0, n - 1) + 1
    big = np.flatnonzero(c > SMALL)
    for part in np.array_split(big, max(1, len(big) // 4096)):
        if len(part):
            out[part] = _walk(c[part], now[part], rule.at(part), rng)
    return out


class Rule:
    """What the restaurant and its parent say of t tables of a dish: the product over j < t of (strength + discount (tables +
    j)) times the parent's probability of one more table, which is p, or p (has + j) / (of + j) as the parent's customers grow."""

    def __init__(self, s: float, d: float, tables: np.ndarray, has: np.ndarray | None, of: np.ndarray | None, p: np.ndarray) -> None:
        self.s, self.d, self.tables, self.has, self.of, self.p = s, d, tables, has, of, p

    def at(self, i: np.ndarray) -> Rule:
        return Rule(self.s, self.d, self.tables[i], *[None if x is None else x[i] for x in (self.has, self.of, self.p)])

    def step(self, i: np.ndarray | slice, j: np.ndarray) -> np.ndarray:
        """Logarithm of the factor j of dish i."""
        room = (self.s + self.d * (self.tables[i] + j)) * self.p[i]
        return np.log(room) if self.has is None else np.log(room * (self.has[i] + j) / (self.of[i] + j))

    def product(self, t: np.ndarray) -> np.ndarray:
        """Logarithm of the product of all factors below t."""
        start = self.s / self.d + self.tables
        out = t * np.log(self.d * self.p) + log_gamma(start + t) - log_gamma(start)
        if self.has is None:
            return out
        return out + log_gamma(self.has + t) - log_gamma(self.has) - log_gamma(self.of + t) + log_gamma(self.of)


def _walk(c: np.ndarray, now: np.ndarray, rule: Rule, rng: np.random.Generator) -> np.ndarray:
    d = rule.d

    def slope(log_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.exp(np.minimum(log_tables_at(log_v, c, d), np.log(c)))
        return t, rule.step(slice(None), t) + np.log(-np.expm1(log_v)) - np.log(c + 1) - (1 - d) * log_v

    def log_chance(t: np.ndarray) -> np.ndarray:
        return log_stirling(c, t, d) + rule.product(t)

    low, high = np.full(len(c), -600.0), np.full(len(c), -1e-13)
    for _ in range(50):
        mid = (low + high) / 2
        rises = slope(mid)[1] > 0
        low, high = np.where(rises, mid, low), np.where(rises, high, mid)
    at = (low + high) / 2
    (t0, s0), (t1, s1) = slope(at * 1.01), slope(at * 0.99)
    spread = np.sqrt(np.maximum(t1 - t0, 1e-9) / np.maximum(s0 - s1, 1e-9))
    middle, scale = np.clip(slope(at)[0], 1, c), 0.6 * np.clip(spread, 0.7, c)
    for _ in range(3):  # as wide as the tail is long
        far = slope(saddle(c, np.minimum(middle + 4 * scale, c), d))[1]
        scale = np.clip(np.maximum(scale, 1 / np.maximum(-far, 1e-9)), 0.4, np.maximum(4 * scale, 1))

    def log_proposed(t: np.ndarray) -> np.ndarray:  # a logistic distribution, rounded
        z, w = np.abs(t - middle) / scale, 0.5 / scale
        return np.where(z < 30, np.log(np.maximum(np.tanh((z + w) / 2) - np.tanh((z - w) / 2), 1e-300)), -z + np.log(2 * np.exp(w) - 2 * np.exp(-w)))

    t = now.copy()
    chance = log_chance(t) - log_proposed(t)
    for _ in range(STEPS):
        u = rng.uniform(1e-12, 1 - 1e-12, len(t))
        new = np.rint(middle + scale * np.log(u / (1 - u))).astype(np.int64)
        inside = (new >= 1) & (new <= c)
        new = np.where(inside, new, t)
        its = log_chance(new) - log_proposed(new)
        takes = inside & (np.log(rng.random(len(t)) + 1e-300) < its - chance)
        t, chance = np.where(takes, new, t), np.where(takes, its, chance)
    return t


class Root:
    """What the root says of a bucket's names: their weights of total, what a weight gains by a customer, and how many
    customers of each are the bucket's own."""

    def __init__(self, weight: np.ndarray, gain: np.ndarray, own: np.ndarray, total: float, least: float) -> None:
        self.weight, self.gain, self.own, self.total, self.least = weight, gain, own, total, least

    def probability(self) -> np.ndarray:
        return self.weight / self.total

    def now(self, own: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and total when the bucket's customers are these."""
        return np.maximum(self.weight + self.gain * (own - self.own), self.least), self.total + float(own.sum() - self.own.sum())


class Bucket:
    """The restaurants of a bucket: triples i in restaurants of pairs (customers c, tables t), which are dishes k in
    restaurants of words (customers c1, tables t1).

    ``hot`` are the words whose restaurants have dishes in several buckets; ``hear`` tells of those elsewhere."""

    def __init__(self, rows: pa.Table, seed: int, discounts: tuple[float, float] | None = None, strengths: tuple[float, float] | None = None, hot: Collection[int] = ()) -> None:
        rows = rows.sort_by("chunk")
        lists = {x: [unpacked(b, x in ("v", "u")) for b in rows[x].to_pylist()] for x in ("v", "u", "w", "c")}
        self.chunks, self.each = rows["chunk"].to_pylist(), np.array([len(x) for x in lists["w"]])
        v, u, w, c = (np.concatenate(lists[x]) for x in ("v", "u", "w", "c"))
        del lists
        room, v = np.unique(v, return_inverse=True)
        self.names, w = np.unique(w, return_inverse=True)
        wide = int(u.max(initial=0)) + 1
        pair, of = np.unique(v * wide + u, return_inverse=True)
        keys, self.asked = np.unique(of * len(self.names) + w, return_inverse=True)  # by pair, and so by word
        self.c = np.bincount(self.asked, c, len(keys)).astype(np.int64)
        self.pair, w = keys // len(self.names), keys % len(self.names)
        self.room_of_pair = pair // wide
        dish, self.dish = np.unique(self.room_of_pair[self.pair] * len(self.names) + w, return_inverse=True)
        self.room, self.word = dish // len(self.names), dish % len(self.names)
        self.number = int(rows["bucket"][0].as_py())
        self.n_rooms, self.rng = len(room), np.random.default_rng([seed, self.number])

        self.t = np.minimum(self.c, 1)
        self.c1 = np.bincount(self.dish, self.t, len(dish)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1)
        own = np.isin(room, np.fromiter(hot, np.int64, len(hot)))
        self.rooms, self.pairs = np.flatnonzero(own), np.flatnonzero(own[self.room_of_pair])  # shared with other buckets
        self.shared = np.append(room[self.room_of_pair[self.pairs]], room[self.rooms]), np.append(pair[self.pairs] % wide, np.full(len(self.rooms), WHOLE))
        self.of_pair = np.bincount(self.pair, self.c, len(pair)).astype(np.int64)
        self.elsewhere = np.zeros((2, len(self.shared[0])), np.int64)  # customers and tables of the shared pairs, then rooms
        self._total()
        self.many = np.flatnonzero(self.c > 1)  # a lone customer has a table of its own in any seating
        self.ones = [int((x == k).sum()) for x in (self.c1, self.c) for k in (1, 2)]
        self.d = discounts or (_discount_of(*self.ones[:2]), _discount_of(*self.ones[2:]))
        self.strengths, self.s, self.likely = strengths, strengths or (1.0, 1.0), np.zeros(2 * len(GRID), np.int64)

    def _own_shared(self) -> np.ndarray:
        """Customers and tables that the shared pairs and rooms have here."""
        n = len(self.of_pair)
        pairs = [np.bincount(self.pair, x, n)[self.pairs] for x in (self.c, self.t)]
        rooms = [np.bincount(self.room, x, self.n_rooms)[self.rooms] for x in (self.c1, self.t1)]
        return np.concatenate([pairs, rooms], axis=1).astype(np.int64)

    def _shared_parts(self, parts: int) -> np.ndarray:
        """Which part adds up each shared pair or room."""
        v, u = self.shared
        return mixed(v * 1_000_003 + u) % parts

    def hear(self, said: dict[int, dict], parts: int) -> None:
        """Takes over what shared restaurants have in other buckets."""
        part = self._shared_parts(parts)
        for p in np.unique(part).tolist():
            self.elsewhere[:, part == p] = unpacked(said[-1 - p]["own"]).reshape(2, -1)
        self.of_pair[self.pairs] += self.elsewhere[0, : len(self.pairs)]
        self._total()

    def _total(self) -> None:
        """Tables of each pair; customers and tables of each word."""
        self.tables = np.bincount(self.pair, self.t, len(self.of_pair)).astype(np.int64)
        self.of_room = np.bincount(self.room, self.c1, self.n_rooms).astype(np.int64)
        self.tables1 = np.bincount(self.room, self.t1, self.n_rooms).astype(np.int64)
        n = len(self.pairs)
        self.tables[self.pairs] += self.elsewhere[1, :n]
        self.of_room[self.rooms] += self.elsewhere[0, n:]
        self.tables1[self.rooms] += self.elsewhere[1, n:]

    def own(self) -> np.ndarray:
        """Customers that the names have in the root from here."""
        return np.bincount(self.word, self.t1, len(self.names)).astype(np.int64)

    def own_root(self) -> Root:
        """By this bucket's words alone."""
        n = self.own()
        return Root(n + 1.0, np.ones(len(n)), n, n.sum() + len(n) + 1.0, 1.0)

    def scan(self, root: Root) -> None:
        """All customers of all dishes leave and sit again.  The root changes by this bucket's own customers only."""
        (d1, d2), (s1, s2) = self.d, self.s
        own = self.own()
        weight, total = root.now(own)
        p = (weight / total)[self.word]
        turn = _turns(self.c[self.many], self.rng)
        for i in (self.many[turn == k] for k in range(TURNS)):
            if not len(i):
                continue
            k, q = self.dish[i], self.pair[i]
            room, others, n1 = self.room[k], self.c1[k] - self.t[i], np.maximum(self.c1[k], 1)
            # When a dish's customers leave the parent, its tables there shrink about as the power d1 of the customers.
            kept = np.where(others > 0, np.clip(self.t1[k] * (others / n1) ** d1, 1, others), 0)
            has = others - d1 * kept + (s1 + d1 * (self.tables1[room] - self.t1[k] + kept)) * p[k]
            now = self.c1[k] - d1 * self.t1[k] + (s1 + d1 * self.tables1[room]) * p[k]
            gain = np.clip((now - has) / self.t[i], 0.1 * (1 - d1), 1)  # of the parent's weight for each customer who comes back
            rule = Rule(s2, d2, self.tables[q] - self.t[i], has / gain, s1 + self.of_room[room] - self.t[i], gain)
            more = draw_tables(self.c[i], self.t[i], rule, self.rng) - self.t[i]
            self.t[i] += more
            for counts, at in ((self.tables, q), (self.c1, k), (self.of_room, room)):
                np.add.at(counts, at, more)
        lone = self.c1 <= 1
        self.t1[lone] = self.c1[lone]
        self.t1 = np.clip(self.t1, np.minimum(self.c1, 1), self.c1)
        self._total()
        weight, total = root.now(own := self.own())
        many = np.flatnonzero(~lone)
        turn = _turns(self.c1[many], self.rng)
        for k in (many[turn == x] for x in range(TURNS)):
            room, w = self.room[k], self.word[k]
            gain = root.gain[w]
            has = np.maximum(weight[w] - gain * self.t1[k], root.least) / gain
            more = draw_tables(self.c1[k], self.t1[k], Rule(s1, d1, self.tables1[room] - self.t1[k], has, total - self.t1[k], gain), self.rng) - self.t1[k]
            self.t1[k] += more
            np.add.at(self.tables1, room, more)
            np.add.at(own, w, more)
            weight, total = root.now(own)

    def burn_in(self, root: Root, scans: int) -> None:
        for k in range(scans):
            self.scan(root)
            if self.strengths is None and not k:
                both = [_likely(self.d[0], self.of_room, self.tables1), _likely(self.d[1], self.of_pair, self.tables)]
                self.s, self.likely = tuple(GRID[int(np.argmax(x))] for x in both), np.concatenate(both)

    def probability(self, root: Root) -> np.ndarray:
        (d1, d2), (s1, s2), p = self.d, self.s, root.probability()[self.word]
        p1 = (self.c1 - d1 * self.t1 + (s1 + d1 * self.tables1[self.room]) * p) / (s1 + self.of_room[self.room])
        return (self.c - d2 * self.t + (s2 + d2 * self.tables[self.pair]) * p1[self.dish]) / (s2 + self.of_pair[self.pair])

    def to_root(self, parts: int) -> Iterator[dict]:
        """The customers that words (but those seen once, which have one each) have in the root, for each of its parts; also of
        words without any here, since texts that are held out ask for them.  Negative parts are those of shared restaurants; one
        of them also gets what discounts and strengths follow from."""
        n = self.own()
        yield from _by_part(self.names, parts, lambda at: {"c": packed(n[at])})
        part, own, words = self._shared_parts(parts), self._own_shared(), np.stack(self.shared)
        levels = [*self.ones, *self.likely.tolist()]
        for p in sorted({self.number % parts, *np.unique(part).tolist()}):
            at = part == p
            yield {"part": -1 - p, "words": packed(words[:, at].ravel()), "c": packed(own[:, at].ravel()), "levels": levels if p == self.number % parts else None}


def _by_part(names: np.ndarray, parts: int, more) -> Iterator[dict]:
    """The words that the root's parts must know, in order."""
    at = np.flatnonzero((names >= FIRST) & (names % 2 == 0))
    part = (names[at] - FIRST) // 2 % parts
    for r in np.unique(part).tolist():
        own = at[part == r]
        yield {"part": r, "words": packed(names[own], True)} | more(own)


def _turns(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Turns of dishes with these customers, dealt anew; the few large ones take two."""
    turn = rng.integers(0, TURNS, len(c))
    return np.where(c > SMALL, turn % 2, turn)


def _discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _likely(d: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """How likely these restaurants are under each strength of GRID, as whole millionths of logarithms, whose sums are exact."""
    many, wide = customers > 1, int(tables.max(initial=0)) + 1
    both, times = np.unique(customers[many] * wide + tables[many], return_counts=True)
    c, t = both // wide, both % wide
    logs = [float((times * (log_gamma(s / d + t) - math.lgamma(s / d + 1) - log_gamma(s + c) + math.lgamma(s + 1))).sum()) for s in GRID]
    return np.rint(np.array(logs) * MICRO).astype(np.int64)


ROOT = "part bigint, bucket array<bigint>, words binary, asked array<binary>, own array<binary>, c binary, ones bigint, twos bigint, total bigint, levels array<bigint>"


def root_part(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """A part of the root: its words and customers, and which of them each bucket has."""
    if rows["part"][0].as_py() < 0:
        return shared_part(rows, schema)
    words = [unpacked(b, True) for b in rows["words"].to_pylist()]
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(at, np.concatenate([unpacked(b) for b in rows["c"].to_pylist()]), len(known)).astype(np.int64)
    asked = [packed(x, True) for x in np.split(at, np.cumsum([len(w) for w in words])[:-1])]
    row = {"part": rows["part"][0].as_py(), "bucket": rows["bucket"].to_pylist(), "words": packed(known, True), "asked": asked, "own": rows["c"].to_pylist(), "c": packed(c), "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "total": int(c.sum())}
    return pa.Table.from_pylist([row], schema)


def shared_part(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """For each bucket, the customers and tables that its shared pairs and rooms have elsewhere; sums of the levels' figures."""
    keys = [unpacked(b).reshape(2, -1) for b in rows["words"].to_pylist()]
    (v, u), own = np.concatenate(keys, axis=1), np.concatenate([unpacked(b).reshape(2, -1) for b in rows["c"].to_pylist()], axis=1)
    _, at = np.unique(v * (int(u.max(initial=0)) + 1) + u, return_inverse=True)
    elsewhere = np.stack([np.bincount(at, x).astype(np.int64)[at] if len(at) else x for x in own]) - own
    told = [packed(x.ravel()) for x in np.split(elsewhere, np.cumsum([k.shape[1] for k in keys])[:-1], axis=1)]
    levels = np.sum([x for x in rows["levels"].to_pylist() if x is not None] or [[0] * (4 + 2 * len(GRID))], axis=0)
    row = {"part": rows["part"][0].as_py(), "bucket": rows["bucket"].to_pylist(), "words": packed(v[:0]), "asked": [], "own": told, "c": packed(v[:0]), "ones": 0, "twos": 0, "total": 0, "levels": levels.tolist()}
    return pa.Table.from_pylist([row], schema)


def root_tables(row: dict, model: dict, scans: int, samples: int) -> list[np.ndarray]:
    """Tables of the part's words in each sample, with the root's number of tables held at what the samples before gave."""
    c, rng, out = unpacked(row["c"].as_py()), np.random.default_rng([model["seed"], 1, int(row["part"].as_py())]), []
    t = np.minimum(c, 1)
    rule = Rule(model["s"], model["d"], np.maximum(0, model["tables"] - t), None, None, np.full(len(c), model["base"]))
    for k in range(scans + samples):
        t = draw_tables(c, t, rule, rng)
        if k >= scans:
            out.append(t)
    return out


def score(docs: DataFrame, rounds: int = ROUNDS, scans: int = SCANS, samples: int = SAMPLES, seed: int = SEED, bucket_tokens: int = BUCKET_TOKENS, discounts: tuple[float, float, float] | None = None, strengths: tuple[float, float, float] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Of the rounds, all but the last only send customers to the root.  discounts and strengths (of the root, of words, of
    pairs) may be given; else they are estimated."""
    spark, ids = docs.sparkSession, kind(docs, "doc_id")
    cut, path = written_at(chunks(docs), "lm-chunks")
    parts = max(1, -(-cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] // PART_TOKENS))
    numbers_schema, texts_schema = _arrow(NUMBERS), _arrow(TEXTS.format(ids))
    words = _map(cut.select("chunk", "words", "counts"), lambda r: to_parts(r, parts), WORDS)
    numbers, numbers_path = written_at(words.groupBy("part").applyInArrow(lambda rows: numbered(rows, parts, bucket_tokens, numbers_schema), NUMBERS), "lm-numbers")
    n, v, once = map(int, numbers.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "known", "once")]).first())
    # Words with more tokens than a bucket: there are fewer of them than buckets.
    hot = {r.id: -(-r.n // bucket_tokens) for r in numbers.select(F.inline("hot")).collect()}
    texts = cut.drop("counts").groupBy("chunk").cogroup(numbers.select("chunk", "part", "numbers", "n").groupBy("chunk"))
    texts = written(texts.applyInArrow(lambda left, right: with_numbers(left, right, parts, n, v, texts_schema), TEXTS.format(ids)), "lm-texts")
    discard(spark, path)
    discard(spark, numbers_path)
    trained = int(texts.select(F.coalesce(F.sum(F.expr("size(filter(held, h -> not h))")), F.lit(0))).first()[0])
    if trained > bucket_tokens:  # each text has one token after the start
        hot[START] = -(-trained // bucket_tokens)
    buckets = max(16, -(-n // bucket_tokens))
    given = (discounts and discounts[1:], strengths and strengths[1:])

    def sends() -> DataFrame:
        def run(row: dict) -> Iterator[dict]:
            t = Triples(row, hot, buckets)
            yield from t.sent(row["chunk"].as_py(), np.repeat(~np.array(row["held"].as_py(), bool), t.sizes))

        return _map(texts.select("chunk", "held", "sizes", "seq", "words"), run, SENT)

    to_root, to_chunks = "part bigint, bucket bigint, words binary, c binary, levels array<bigint>", "chunk bigint, bucket bigint, logs binary"
    root_schema, up_schema, answer_schema = map(_arrow, (ROOT, to_root, to_chunks))

    def root_after(up: DataFrame, lower: tuple | None = None) -> tuple[dict, DataFrame]:
        """The root, sampled from the customers that buckets send: its totals, and what it says to each bucket; also the
        discounts and strengths of the lower levels, unless these are known."""
        root = written(up.groupBy("part").applyInArrow(lambda rows: root_part(rows, root_schema), ROOT), "lm-root")
        free_shuffles(spark)
        ones, twos, customers = map(int, root.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("ones", "twos", "total")]).first())
        model = {"d": discounts[0] if discounts else _discount_of(ones + once, twos), "s": strengths[0] if strengths else 1.0, "base": 1 / (v + 1), "seed": seed, "tables": v, "customers": customers + once, "lower": lower}
        if lower is None:
            a, b, c, d, *likely = root.filter("part < 0").agg(*[F.coalesce(F.sum(F.col("levels")[k]), F.lit(0)) for k in range(4 + 2 * len(GRID))]).first()
            best = tuple(GRID[int(np.argmax(likely[k : k + len(GRID)]))] for k in (0, len(GRID)))
            model["lower"] = (given[0] or (_discount_of(a, b), _discount_of(c, d)), given[1] or best)

        def tables(model: dict) -> list[int]:
            """The root's tables in each sample."""
            own = _map(root.filter("part >= 0").select("part", "c"), lambda r: [{"k": k, "t": int(t.sum())} for k, t in enumerate(root_tables(r, model, scans, samples))], "k int, t bigint")
            got = {r.k: r.t for r in own.groupBy("k").agg(F.sum("t").alias("t")).collect()}
            return [once + got.get(k, 0) for k in range(samples)]

        model["tables"] = tables(model)[-1]
        model["totals"] = tables(model)

        def down(row: dict) -> Iterator[dict]:
            if row["part"].as_py() < 0:
                yield from ({"bucket": b, "part": row["part"].as_py(), "own": own, "c": row["c"].as_py(), "t": []} for b, own in zip(row["bucket"].as_py(), row["own"].as_py()))
                return
            c, ts = unpacked(row["c"].as_py()), root_tables(row, model, scans, samples)
            for b, asked, own in zip(row["bucket"].as_py(), row["asked"].as_py(), row["own"].as_py()):
                at = unpacked(asked, True)
                yield {"bucket": b, "part": row["part"].as_py(), "own": own, "c": packed(c[at]), "t": [packed(t[at]) for t in ts]}

        return model, _map(root, down, "bucket bigint, part bigint, own binary, c binary, t array<binary>")

    def root_of(names: np.ndarray, rows: dict[int, dict], model: dict) -> list[Root]:
        """The root in each sample, as a bucket with these names sees it."""
        seen_once, out = ((names >= FIRST) & (names % 2 == 1)).astype(np.float64), []
        for k in range(samples):
            c, t, own = seen_once.copy(), seen_once.copy(), seen_once.copy()
            for x in _by_part(names, parts, lambda at: {"at": at}):
                row = rows[x["part"]]
                c[x["at"]], t[x["at"]], own[x["at"]] = unpacked(row["c"]), unpacked(row["t"][k]), unpacked(row["own"])
            back = (model["s"] + model["d"] * model["totals"][k]) * model["base"]
            out.append(Root(c - model["d"] * t + back, 1 - model["d"] * np.where(c > 0, t / np.maximum(c, 1), 1), own, model["s"] + model["customers"], back))
        return out

    def told_bucket(rows: pa.Table, said: pa.Table, seed: int, model: dict) -> tuple[Bucket, list[Root]]:
        b, parts_said = Bucket(rows, seed, *model["lower"], hot), {x["part"]: x for x in said.to_pylist()}
        b.hear(parts_said, parts)
        return b, root_of(b.names, parts_said, model)

    def upward(b: Bucket, rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([x | {"bucket": rows["bucket"][0].as_py()} for x in b.to_root(parts)], up_schema)

    def first(rows: pa.Table) -> pa.Table:
        b = Bucket(rows, seed, *given, hot)
        b.burn_in(b.own_root(), scans)
        return upward(b, rows)

    def again(k: int, model: dict):
        def run(rows: pa.Table, said: pa.Table) -> pa.Table:
            b, roots = told_bucket(rows, said, seed + k, model)
            b.burn_in(roots[-1], scans)
            return upward(b, rows)

        return run

    free_shuffles(spark)
    model, told = root_after(sends().groupBy("bucket").applyInArrow(first, to_root))
    for k in range(1, rounds - 1):
        model, told = root_after(sends().groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(again(k, model), to_root), model["lower"])

    def answers(rows: pa.Table, said: pa.Table) -> pa.Table:
        b, roots = told_bucket(rows, said, seed, model)
        b.burn_in(roots[0], scans)
        p = np.zeros(len(b.c))
        for r in roots:
            b.scan(r)
            p += b.probability(r)
        logs = np.rint(-MICRO * np.log10(p / samples)).astype(np.int64)
        number, cuts = rows["bucket"][0].as_py(), np.cumsum(b.each)[:-1]
        return pa.Table.from_pylist([{"chunk": c, "bucket": number, "logs": packed(logs[at])} for c, at in zip(b.chunks, np.split(b.asked, cuts))], answer_schema)

    answered = sends().groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(answers, to_chunks)
    answered = written(answered, "lm-answers")
    free_shuffles(spark)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        logs = np.concatenate([unpacked(x) for x in right["logs"].to_pylist()])
        out = []
        for row in ({c: left[c][k] for c in left.column_names} for k in range(left.num_rows)):
            t = Triples(row, hot, buckets)
            own = np.empty(len(t.w), np.int64)
            own[np.argsort(t.bucket, kind="stable")] = logs
            sums = np.add.reduceat(own[t.where], np.cumsum(t.sizes) - t.sizes)
            out.append(pa.table({"doc_id": row["ids"].values, "held_out": row["held"].values, "n_tokens": t.sizes, "n_known": row["n_known"].values, "train_tokens": np.full(len(sums), n, np.int64), "base_score": row["base"].values, "score": sums / -MICRO}))
        return pa.concat_tables(out)

    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(scored, f"doc_id {ids}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
