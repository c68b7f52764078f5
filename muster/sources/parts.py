"""Files that tasks read by parts: what Spark's text reader cuts at every separator, and where in a file its blocks lie.

An upload may also be a folder, as uploads in parts leave them: the bytes of its files, in the order of their names, are the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import scratch
from ..errors import IngestionError

#: Marks of JSON by their codes; what each adds to the depth.
OPENED, COMMA, CLOSED = (1, 2), 3, 4
CODES, STEPS, ESCAPED, DEEP = np.zeros(256, np.int8), np.array([0, 1, 1, 0, -1, -1]), re.compile(rb"\\.", re.S), 1 << 40
CODES[list(b"[{,]}")] = range(1, 6)
SCANNED = "file bigint, block bigint, quotes bigint, outside bigint, inside bigint, low_outside bigint, low_inside bigint, bytes bigint, odd boolean"


def files(spark: SparkSession, path: str) -> list:
    """Files of an upload in the order of their names: their key, path and length."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.xxhash64(found.metadataColumn("_metadata")["file_path"]).alias("file"), "path", "length").orderBy("path").collect()


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block and value of the pieces between separators, in order within a block."""
    found = spark.read.option("lineSep", separator).text(path)
    where = found.metadataColumn("_metadata")
    return found.select(F.xxhash64(where["file_path"]).alias("file"), where["file_block_start"].alias("block"), "value")


def stretches(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The file and block, and the bytes, of pieces that lie in one block; each but the block's first comes after a separator."""
    last = None
    for b in batches:
        file, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        ends = [*(np.flatnonzero(np.diff(file).astype(bool) | np.diff(block).astype(bool)) + 1).tolist(), len(b)] if len(b) else []
        for lo, hi in zip([0, *ends], ends):
            key = int(file[lo]), int(block[lo])
            texts = b.column(2).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
            yield key, separator.join([b"", *texts] if key == last else texts)
            last = key


def ended(listed: list, blocks: list) -> dict[int, bool] | None:
    """Whether a separator follows a file's last piece: its length tells.  None if a file but the first has a byte order mark, which the reader drops."""
    size = {f["file"]: sum(b["bytes"] for b in blocks if b["file"] == f["file"]) - f["length"] for f in listed}
    return None if any(size[f["file"]] < 0 for f in listed[1:]) else {k: n % 3 == 0 for k, n in size.items()}


def in_order(listed: list, blocks: list) -> list:
    at = {f["file"]: k for k, f in enumerate(listed)}
    return sorted(blocks, key=lambda b: (at[b["file"]], b["block"]))


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and codes of brackets and commas, the quotes before each, and all quotes; what is escaped is none of them."""
    plain = np.frombuffer(ESCAPED.sub(b"..", data) if b"\\" in data else data, np.uint8)
    at, quotes = np.flatnonzero(CODES[plain]), np.flatnonzero(plain == ord('"'))
    return at, CODES[plain[at]], np.searchsorted(quotes, at), len(quotes)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: its quotes, and by how much the depth changes and how low it gets if it begins outside or inside a text."""
    seen: dict[tuple[int, int], list] = {}
    for key, data in stretches(batches, b"}"):
        s = seen.setdefault(key, [0, 0, 0, DEEP, DEEP, 1, False])
        at, code, before, quotes = _marks(data)
        for k in (0, 1):
            c = code[(before + s[0]) % 2 == k]
            if len(c):
                depth = s[1 + k] + np.cumsum(STEPS[c])
                s[1 + k], s[3 + k] = int(depth[-1]), min(s[3 + k], int((depth + (c >= CLOSED)).min()))
        s[0] += quotes
        s[5] += len(data)
        s[6] |= b"\0" in data or ESCAPED.sub(b"", data).endswith(b"\\")
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*k, *s) for k, s in seen.items()])], names=[x.split()[0] for x in SCANNED.split(", ")])


def _states(spark: SparkSession, path: str, level: int) -> dict | None:
    """How each block begins: its number, inside a text or not, the depth, the block in which the value that it begins in began, and
    whether a separator follows it.  None if quotes or brackets don't match."""
    listed = files(spark, path)
    blocks = in_order(listed, pieces(spark, path, "}").mapInArrow(_scan, SCANNED).collect())
    follows = ended(listed, blocks)
    if follows is None or any(b["odd"] for b in blocks):
        return None
    states, inside, depth, chain = {}, False, 0, -1
    for k, b in enumerate(blocks):
        sep = k + 1 < len(blocks) and blocks[k + 1]["file"] == b["file"] or follows[b["file"]]
        states[b["file"], b["block"]] = (k, inside, depth, chain, sep)
        if depth + b["low_inside" if inside else "low_outside"] <= level:
            chain = k
        depth += b["inside" if inside else "outside"]
        inside ^= b["quotes"] % 2 == 1
        if sep and not inside:
            chain, depth = k if depth <= level else chain, depth - 1
    return states if not inside and not depth else None


def _fields(spark: SparkSession, path: str, level: int, states: dict) -> DataFrame:
    """The texts between brackets and commas down to a level.  place: the block's number and how many brackets have opened the level
    in it; kind: the depth, and the marks before and after; chain: set for texts that a block's end cuts, the same for all their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def take(data: bytes) -> Iterator[pa.RecordBatch]:
            nonlocal inside, depth, opened, last, within, held
            at, code, before, quotes = _marks(data)
            out = (before + inside) % 2 == 0
            inside = (inside + quotes) % 2
            at, code = at[out], code[out]
            depths = depth + np.cumsum(STEPS[code])
            depth = int(depths[-1]) if len(depths) else depth
            cut = depths + (code >= CLOSED) <= level
            at, code, depths = at[cut], code[cut], depths[cut]
            if not len(at):
                held.append(data)
                return
            text, ends = b"".join([*held, data[: at[-1]]]), at + sum(map(len, held)) - np.arange(len(at))
            plain = np.delete(np.frombuffer(text, np.uint8), (ends + np.arange(len(at)))[:-1])
            texts = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(plain))
            opens = opened + np.append(0, np.cumsum((code <= OPENED[-1]) & (depths == level)))
            kinds = np.append(within, depths[:-1]) * 64 + np.append(last, code[:-1]) * 8 + code
            chains = pa.array([chain if last == 0 else None, *[None] * (len(at) - 1)], pa.int64())
            yield batch((number << 32) + opens[:-1], kinds, chains, texts)
            held, opened, last, within = [data[at[-1] + 1 :]], int(opens[-1]), int(code[-1]), int(depths[-1])

        def batch(places: np.ndarray, kinds: np.ndarray, chains: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(kinds, pa.int64()), chains, texts], names=["place", "kind", "chain", "text"])

        def end() -> Iterator[pa.RecordBatch]:
            """The rest of a block."""
            if sep:
                yield from take(b"}")
            text = b"".join(held)
            texts = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text))
            yield batch([(number << 32) + opened], [within * 64 + last * 8], pa.array([number if last else chain], pa.int64()), texts)

        for k, data in stretches(batches, b"}"):
            if k != key:
                if key:
                    yield from end()
                if k not in states:
                    raise IngestionError(f"{path} has been cut into other parts since it was looked at; read it again")
                key, held, opened, last = k, [], 0, 0
                number, inside, depth, chain, sep = states[k]
                within = min(depth, level)
            yield from take(data)
        if key:
            yield from end()

    return pieces(spark, path, "}").mapInArrow(run, "place bigint, kind bigint, chain bigint, text string")


def json_elements(spark: SparkSession, path: str, root: str, table: int) -> tuple[list[str], DataFrame] | None:
    """Keys of the first object, and the texts (column ``text``) of all elements, of the root array or of the table-th shortest array in the
    root object.  None if this isn't JSON, repeats a key, has an array of other values at its root, or holds no such array of objects.

    A first pass finds how each block begins, a second one checks and counts all values, and the elements are a third; no task holds more than a
    batch of texts."""
    level = 1 if root == "[" else 2
    states = _states(spark, path, level)
    if not states:
        return None
    fields, depth, before, after = _fields(spark, path, level, states), F.expr("kind div 64"), F.expr("kind div 8 % 8"), F.expr("kind % 8")
    blank = F.btrim("text", F.lit(" \t\r\n")) == ""
    member = F.concat(F.lit("{"), "text", F.when(after.isin(*OPENED), " null").otherwise(""), F.lit("}"))
    array = ~blank & (depth == level) & F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))).isNotNull()
    keys = F.when((depth == level) & (before == OPENED[0]), F.json_object_keys("text")).when((depth == 1) & after.isin(*OPENED), F.json_object_keys(member))
    judged = lambda df: df.withColumn("array", array).withColumn("member", ~blank & ~F.col("array") & (depth > 0) & F.try_parse_json(member).isNotNull())
    whole, counts = F.col("chain").isNull(), lambda on: [F.count_if(on).alias("n"), F.count_if(on & F.col("array")).alias("arrays"), F.count_if(on & F.col("member")).alias("members"), F.count_if(on & blank).alias("blanks"), F.count_if(on & F.startswith(F.ltrim("text", F.lit(" \t\r\n")), F.lit("{"))).alias("objects"), F.first(F.when(on, keys), ignorenulls=True).alias("keys")]
    cut = F.collect_list(F.when(~whole, F.struct("chain", "place", "kind", "text"))).alias("cut")
    judged(fields).groupBy("place", "kind").agg(*counts(whole), cut).write.parquet(to := scratch(spark, "json"))
    told = spark.read.parquet(to)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text")
    ends = told.select(F.inline("cut")).groupBy("chain").agg(F.max("place").alias("place"), F.bit_or("kind").alias("kind"), joined)
    sums = [r for r in told.drop("cut").union(judged(ends).groupBy("place", "kind").agg(*counts(F.lit(True)))).collect() if r["n"]]
    chosen = _chosen(sums, level, table)
    if chosen is None:
        return None
    names, first, beyond = chosen
    here = (depth == level) & (F.col("place") >= first) & (F.col("place") < beyond) & ~blank
    return names, fields.filter(whole & here).select("text").union(ends.filter(here).select("text"))


def _chosen(sums: list, level: int, table: int) -> tuple[list[str], int, int] | None:
    """Keys of the first element of the array that is asked for, and its places; None if the marks between texts aren't JSON's."""
    square, curly, comma, closes, closed, rest = 1, 2, COMMA, 4, 5, 0
    heads = sorted((r["place"] + 1, r) for r in sums if level == 2 and r["kind"] // 64 == 1 and r["kind"] % 8 in OPENED)
    starts = [0, *[p for p, _ in heads]]
    marks = {p: r["kind"] % 8 for p, r in heads}
    if any(r["n"] != 1 or not r["keys"] for _, r in heads) or len({r["keys"][0] for _, r in heads}) < len(heads):
        return None
    size, names = dict.fromkeys(starts, 0), {}
    for r in sums:
        depth, before, after, n = r["kind"] // 64, r["kind"] // 8 % 8, r["kind"] % 8, r["n"]
        start = starts[bisect_right(starts, r["place"]) - 1] if level == 2 else 0
        mark = marks.get(start) if level == 2 and depth == 2 else square if level == 1 else curly
        if depth == 0:
            good = r["blanks"] == n and (before == rest and after == mark or before == mark + 3 and after == rest)
        elif before == mark and after == mark + 3 and r["blanks"]:
            good = r["blanks"] == n or r["blanks"] + (r["arrays"] if mark == square else r["members"]) == n
        elif depth < level and before in (closes, closed):
            good = r["blanks"] == n and after in (comma, mark + 3)
        else:
            good = before in (mark, comma) and (after in (comma, mark + 3) or depth < level and after in OPENED)
            good = good and (r["arrays"] if mark == square else r["members"]) == n
        if not good or level == 1 and depth and r["objects"] + r["blanks"] != n:
            return None
        if depth == level:
            size[start] += r["arrays"]
            names[start] = names.get(start) or r["keys"]
    arrays = [0] if level == 1 else [p for p, r in sorted(heads, key=lambda x: x[1]["keys"][0]) if marks[p] == square]
    if level == 2 and table >= len(arrays):
        return None
    start = sorted(arrays, key=size.get)[0 if level == 1 else table]
    if not names.get(start):
        return None
    return sorted(set(names[start])), start, next((p for p in starts if p > start), 1 << 62)
