"""Alignment of the tokens of two tokenizers.

Both tokenizers cut the same bytes, a space and the text.  In each Arrow partition, DuckDB holds tables of the two sides' token
intervals: an ASOF join gives each token of A the last token of B that starts where it does or before; where both start
together a new group begins, and a window's running sum numbers the groups; a range join (ASOF again) puts each token of B into
the group in which it starts.  Tokens of a group overlap no token of another one.  Every pair of an A token and a B token of a
group is a link.  DuckDB counts the links of each document by pairs of ids, and how many documents of the partition hold
each pair; these partial counts are merged in Spark, which also finds the highest count of each id of A.  The counts go back to
the partitions that asked for them, so what is joined is a row for each pair of a partition, never one for each link.

In a chunk with a large group, pairs are counted by distinct ids: ids that repeat within a group multiply.

Texts are cut before a space that follows a character that is no white space; no token of either side goes over such a place
(the pattern of A begins a match there, and ``Pair`` refuses a vocabulary of B with a piece that holds a space behind
another character).  So a worker hands each cut part to the libraries once and remembers its ids.

Defined results: documents whose text is null, empty or such that the joined bytes of a side aren't a space and the text (as
with bytes that aren't UTF-8) have no tokens, zeros, and '' as groups_sha256; texts of any length are taken whole; repeated rows
count as documents of their own; an empty table gives no rows; columns but the two named are not looked at, whatever
their names; identifiers may be null or equal.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import coded, kind, slices, table, text_bytes, written_at
from .records import ragged

#: Bytes of text whose tokens DuckDB aligns at once, about; its memory, and places of its own are only used beyond that.
CHUNK_BYTES, MEMORY = 1 << 20, "256MB"
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 3 << 17
CUT, SPACES = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: Pairs of tokens of a group up to which the tokens are paired as they are.
MOST_PAIRS = 256


def parts_of(text: str) -> list[str]:
    """The parts of a space and the text, each without the space with which it begins."""
    return text.split(" ") if text[0] != " " and not SPACES.search(text) else CUT.split(text)




class Pair:
    """The two tokenizers, what bytes their tokens stand for, and the ids of parts of texts seen so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the other bytes stand as characters from 256 on
        byte_of = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(printable)))}
        vocabulary, self.a_bytes = self.a.get_vocab(with_added_tokens=False), []
        for token, k in sorted(vocabulary.items(), key=lambda x: x[1]):
            self.a_bytes += [b""] * (k - len(self.a_bytes)) + [bytes(byte_of[c] for c in token)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if wide := next((p for p in pieces if re.search("[^▁]▁", p)), None):
            raise ValueError(f"the piece {wide!r} goes over a space, so texts can't be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.space = [self.b.piece_to_id("▁")]
        self.sides = [self.side(self.a_bytes), self.side(self.b_bytes)]
        self.forget()

    @staticmethod
    def side(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        return pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)

    def forget(self) -> None:
        self.codes: defaultdict = defaultdict(count().__next__)
        self.ids, self.sizes = [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides for texts that aren't empty."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        known = len(self.codes)
        parts = [coded(parts_of(t.decode(errors="replace")), self.codes) for t in texts]
        new = list(islice(self.codes, known, None))
        ids = [x.ids for x in self.a.encode_batch_fast([" " + t for t in new], add_special_tokens=False)]
        # B puts a space before what it encodes, but for nothing.
        for side, ids in enumerate((ids, [x or self.space for x in self.b.encode(new, num_threads=1)])):
            self.ids[side] = np.concatenate((self.ids[side], np.fromiter(chain.from_iterable(ids), np.int32)))
            self.sizes[side] = np.concatenate((self.sizes[side], np.fromiter(map(len, ids), np.int64, len(ids))))
        begins = [np.cumsum(s) - s for s in self.sizes]
        return tuple([ids[ragged(at[k], size[k])] for k in parts] for ids, size, at in zip(self.ids, self.sizes, begins))

    def intervals(self, texts: list[bytes | None]) -> tuple[pa.Table, pa.Table]:
        """Tables doc, id, lo of the tokens of both sides, with places counted over all texts; texts that the sides don't cut
        have none."""
        docs = [k for k, t in enumerate(texts) if t]
        both = self.encode([texts[k] for k in docs])
        good, joined = np.ones(len(docs), bool), []
        for ids, (tokens, _) in zip(both, self.sides):
            ends, data = np.cumsum([len(x) for x in ids], dtype=np.int64), tokens.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            at = np.frombuffer(data.buffers()[1], np.int64)[: len(data) + 1] if len(data) else np.zeros(1, np.int64)
            joined.append((at[np.append(0, ends)], memoryview(data.buffers()[2]).cast("B") if len(data) else memoryview(b"")))
        for k, d in enumerate(docs):
            good[k] = all(view[at[k] : at[k + 1]] == b" " + texts[d] for at, view in joined)
        begin = np.cumsum([0, *[len(texts[d]) + 1 if g else 0 for d, g in zip(docs, good)]])
        out = []
        for ids, (_, lengths) in zip(both, self.sides):
            own = [(d, x, begin[k]) for k, (d, x) in enumerate(zip(docs, ids)) if good[k]]
            flat = np.concatenate([np.zeros(0, np.int32), *[x for _, x, _ in own]])
            doc = np.repeat(np.array([d for d, *_ in own], np.int64), [len(x) for _, x, _ in own])
            size = lengths[flat]
            out.append(pa.table({"doc": doc, "id": flat, "lo": np.cumsum(size) - size}))  # texts follow each other without gaps
        return tuple(out)


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One for each Python worker."""
    return Pair(a_path, b_path)


#: Tokens of A with the number of their group; a new one begins where both sides start together.
A_GROUPS = """CREATE OR REPLACE TEMP TABLE ag AS
SELECT a.doc, a.id, a.lo, CAST(sum(CAST(a.lo = b.lo AS INTEGER)) OVER (ORDER BY a.lo ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM a ASOF JOIN b ON a.lo >= b.lo"""
B_GROUPS = "CREATE OR REPLACE TEMP TABLE bg AS SELECT b.doc, b.id, b.lo, ag.g FROM b ASOF JOIN ag ON b.lo >= ag.lo"
#: Links of each document by pairs of ids.
LINKS = "CREATE OR REPLACE TEMP TABLE links AS SELECT ag.doc, ag.id AS a, bg.id AS b, count(*) AS n FROM ag JOIN bg USING (g) GROUP BY ALL"
#: The same where groups are large: a group's ids are counted first.
LINKS_OF_LARGE = """CREATE OR REPLACE TEMP TABLE links AS SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT x.doc, x.id AS a, y.id AS b, x.n * y.n AS n
  FROM (SELECT doc, g, id, count(*) AS n FROM ag GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS n FROM bg GROUP BY ALL) y USING (g)) GROUP BY ALL"""
PAIRS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS k, n FROM (SELECT a, b, count(*) AS n FROM links GROUP BY ALL)"


def ordered(tokens: dict) -> dict:
    """Columns in the order of places; DuckDB mostly gives them so."""
    lo = tokens["lo"]
    return tokens if (lo[1:] > lo[:-1]).all() else {c: x[np.argsort(lo)] for c, x in tokens.items()}


def _joined(ag: dict, bg: dict, n_docs: int) -> list[str]:
    """For each document the digest of `a1,a2|b1;a3|b2,b3`: the ids of its groups in order."""
    (ad, ai, a), (bd, bi, b) = ([x[c] for c in ("doc", "id", "g")] for x in (ag, bg))
    place_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
    n = len(a) + len(b)
    if not n:
        return [""] * n_docs
    ids, g, side, doc = (np.empty(n, np.int64) for _ in range(4))
    for at, values in ((place_a, (ai, a, 0, ad)), (place_b, (bi, b, 1, bd))):
        for to, x in zip((ids, g, side, doc), values):
            to[at] = x
    # What follows an id: a comma, a bar between the sides, a semicolon after a group, nothing after a text.
    then = np.zeros(n, np.int64)
    then[:-1] = np.where(g[1:] != g[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    then[cuts[1:][cuts[1:] > cuts[:-1]] - 1] = 3
    width = int(ids.max(initial=0)) + 1
    used, at = np.unique(then * width + ids, return_inverse=True)
    text = pa.array([str(k % width) + ",|;"[k // width : k // width + 1] for k in used.tolist()], pa.large_string()).take(pa.array(at))
    offsets, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2])
    return [hashlib.sha256(data[offsets[lo] : offsets[hi]]).hexdigest() if hi > lo else "" for lo, hi in zip(cuts, cuts[1:])]


ALIGNED = "chunk bigint, id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair array<int>, times array<bigint>, pairs array<struct<a:int,b:int,k:int,n:bigint>>"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: chunk (the texts that were aligned together), id, the counts, pair and times (numbers of the pairs
    that it links, and how often); the first row of a chunk has its pairs: ids a and b, number k, and n documents of it."""
    pair(a_path, b_path)  # mistakes show here, not in a task
    schema = ALIGNED.format(kind(docs, id_col))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # A chunk of usual texts needs less than this memory; what a longer one needs lies in a folder of the task's own meanwhile.
        with tempfile.TemporaryDirectory() as own, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own}) as db:
            for b in (part for whole in batches for part in slices(whole, 1, CHUNK_BYTES)):
                n = b.num_rows
                a_tokens, b_tokens = pair(a_path, b_path).intervals(b.column(1).to_pylist())
                db.register("a", a_tokens)
                db.register("b", b_tokens)
                db.execute(A_GROUPS)
                db.execute(B_GROUPS)
                ag, bg = (ordered(db.execute(f"SELECT doc, id, g, lo FROM {x}").fetchnumpy()) for x in ("ag", "bg"))
                sizes = [np.bincount(x["g"]) for x in (ag, bg)]
                db.execute(LINKS_OF_LARGE if np.max(sizes[0] * sizes[1], initial=0) > MOST_PAIRS else LINKS)
                db.execute(PAIRS)
                links = db.execute("SELECT doc, k, links.n FROM links JOIN pairs USING (a, b) ORDER BY doc, k").fetchnumpy()
                pairs = db.execute("SELECT a, b, k, n FROM pairs ORDER BY k").fetchnumpy()
                db.unregister("a")
                db.unregister("b")
                n_pairs = np.bincount(links["doc"], minlength=n)
                groups = np.flatnonzero(np.diff(ag["g"], prepend=-1))
                struct = out.field("pairs").type.value_type
                rows = pa.StructArray.from_arrays([pa.array(pairs[f.name], f.type) for f in struct], fields=list(struct))
                ends = np.append(0, np.full(n, len(rows)))
                columns = [
                    pa.array(np.full(n, uuid.uuid4().int >> 65), pa.int64()), b.column(0), *[pa.array(np.bincount(x, minlength=n), pa.int64()) for x in (ag["doc"], bg["doc"], ag["doc"][groups])],
                    pa.array(np.bincount(links["doc"], links["n"], n).astype(np.int64)), pa.array(_joined(ag, bg, n)), _lists(links["k"], n_pairs, pa.int32()), _lists(links["n"], n_pairs, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=out.field("pairs").type),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return docs.select(F.col(f"`{id_col}`").alias("k"), text_bytes(text_col).alias("t")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (documents of all chunks that hold the pair linked) and best (whether no pair of a has more)."""
    counts = rows.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    rows, path = written_at(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    own = docs.sparkSession.read.schema(rows.schema).parquet(path).drop("pairs")
    counts = pair_counts(rows).withColumnRenamed("n", "total")
    asked = rows.select("chunk", F.inline("pairs")).join(counts, ["a", "b"]).select("chunk", "k", "total", "best")
    schema = f"id {kind(rows, 'id')}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("k")
        total, best = (right[c].to_numpy() for c in ("total", "best"))
        k, times = (np.asarray(left[c].combine_chunks().flatten()) for c in ("pair", "times"))
        row = np.repeat(np.arange(left.num_rows), np.asarray(left["pair"].combine_chunks().value_lengths()))
        sums = {"n_best": times * best[k], "count_sum": times * total[k]} if len(k) else {"n_best": times, "count_sum": times}
        added = {c: np.zeros(left.num_rows, np.int64) for c in sums}
        for c, x in sums.items():
            np.add.at(added[c], row, x.astype(np.int64))
        return pa.Table.from_arrays([pa.array(added[f.name]) if f.name in added else left[f.name] for f in out], schema=out)

    return own.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(summed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumnRenamed("id", "doc_id")
