"""Token ids in length-delimited binary records.

Documents are sorted into ranges of their identifiers, a task each; a task encodes its documents and writes their records to
files of about ``FILE_BYTES``.  A record is framed as

    length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload (4)

all little-endian, which readers of TFRecord files take.  The payload begins with three numbers of 4 bytes: the length of the
identifier's text (2**32 - 1 for null), the bytes of an id (2 if the vocabulary has no more than 65,536 entries, else 4) and the
number of ids; the identifier's text in UTF-8 and the ids follow, each with zero bytes up to a multiple of four.  Masking turns
a checksum by 15 bits and adds a constant, so checksums of data that hold checksums stay good.

The offset index is a Parquet table of its own: for each record its file, place, length and number of ids, and what the
tasks before it have written.  ``read`` takes any rows of the index in any order, so reads may be shuffled, and verifies both
checksums of each record; ``read_files`` reads whole files one after the other without looking at places.  Only files that the
index names count: tasks write files with names of their own and Spark commits the index, so a task that is lost or runs twice leaves
at most files that nothing reads.

Checksums are linear, so those of all records of a batch are computed together, as a tree over words of four bytes.

The files must be in a place that pyarrow can write to (a shared folder, HDFS, or the usual object stores).

Defined results: a null text counts as empty and has the end id only; a null identifier comes first; rows with the same
identifier come by a hash of their texts and then by the texts; repeated rows are repeated; texts of any length are taken
whole; bytes that aren't UTF-8 count as U+FFFD; an empty table gives no files and an empty index; columns but the two named
are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import kind, scratch, slices, table, text_bytes, written

#: The id that ends each document of the query.
END = 2
#: Bytes of text in a range, about; fewer where tasks would else be fewer than ``TASKS``, but ``LEAST_BYTES`` at least.
RANGE_BYTES, TASKS, LEAST_BYTES = 64 << 20, 16, 1 << 20
#: Bytes of a file, about.
FILE_BYTES = 64 << 20
#: Bytes of texts that are encoded together, about.
TOGETHER = 8 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 3 << 18
#: Tasks that read whole files, at most.
MOST_READERS = 50_000
NULL = 0xFFFFFFFF
#: Fixed values of the format: CRC-32C's polynomial, reflected, and the constant of masks.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For k from 0: what 4 * 2**k zero bytes make of a checksum's four bytes, as tables."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> np.uint32(1) ^ np.uint32(POLYNOMIAL), byte >> np.uint32(1))

    def tables(bits: np.ndarray) -> np.ndarray:
        """From what becomes of each of the 32 bits."""
        out = np.zeros((4, 256), np.uint32)
        for k in range(32):
            out[k // 8] ^= np.where(np.arange(256) >> k % 8 & 1, bits[k], 0).astype(np.uint32)
        return out

    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(4):
        bits = bits >> np.uint32(8) ^ byte[bits & np.uint32(255)]
    all_ = []
    for _ in range(40):
        all_.append(tables(bits))
        bits = _shifted(bits, all_[-1])
    return np.stack(all_)


def _shifted(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def crc32c(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of consecutive stretches of little-endian words of four bytes, ``sizes`` words each."""
    shifts = _shifts()
    v, n, level = _shifted(words.astype(np.uint32), shifts[0]), np.asarray(sizes, np.int64), 0
    while n.max(initial=0) > 1:
        odd, half = n & 1, (n + 1) // 2
        both = np.zeros(int(2 * half.sum()), np.uint32)  # a zero word in front changes nothing
        both[np.arange(len(v)) + np.repeat(2 * (np.cumsum(half) - half) + odd - (np.cumsum(n) - n), n)] = v
        v, n, level = _shifted(both[0::2], shifts[level]) ^ both[1::2], half, level + 1
    raw, start = np.zeros(len(n), np.uint32), np.full(len(n), 0xFFFFFFFF, np.uint32)
    raw[n > 0] = v
    for k in range(int(np.max(sizes, initial=0)).bit_length()):
        start = np.where(np.asarray(sizes) >> k & 1, _shifted(start, shifts[k]), start)
    return raw ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK)


def payload(key: str | None, ids: np.ndarray, width: int = 4) -> bytes:
    name, data = b"" if key is None else key.encode(), ids.astype(f"<u{width}").tobytes()
    return struct.pack("<III", NULL if key is None else len(name), width, len(ids)) + name + bytes(-len(name) % 4) + data + bytes(-len(data) % 4)


def parsed(data: bytes) -> tuple[str | None, np.ndarray]:
    n, width, count = struct.unpack_from("<III", data)
    size = 0 if n == NULL else n
    return None if n == NULL else data[12 : 12 + n].decode(), np.frombuffer(data, f"<u{width}", count, 12 + size + -size % 4).astype("<u4")


def _checksums(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Masked checksums of the lengths and of the payloads."""
    lengths = np.array([len(p) for p in payloads], "<u8")
    of_lengths = crc32c(lengths.view("<u4"), np.full(len(payloads), 2))
    return masked(of_lengths), masked(crc32c(np.frombuffer(b"".join(payloads), "<u4"), lengths.astype(np.int64) // 4))


def framed(payloads: list[bytes]) -> list[bytes]:
    a, b = _checksums(payloads)
    return [struct.pack("<QI", len(p), x) + p + struct.pack("<I", y) for p, x, y in zip(payloads, a.tolist(), b.tolist())]


def unframed(frames: list[bytes], where: str) -> list[bytes]:
    """The payloads; ValueError if a length or a checksum isn't right."""
    payloads = [f[12:-4] for f in frames]
    a, b = _checksums([p if len(p) % 4 == 0 else b"" for p in payloads])
    for k, (f, p, x, y) in enumerate(zip(frames, payloads, a.tolist(), b.tolist())):
        if len(p) % 4 or struct.unpack_from("<QI", f) != (len(p), x) or struct.unpack("<I", f[-4:])[0] != y:
            raise ValueError(f"record {k} of those read from {where} is damaged")
    return payloads


class Encoder:
    """A tokenizer of the tokenizers library, for texts in UTF-8.

    With ``by_word``, which holds for tokenizers that never join what white space separates and drop it, a worker
    hands each word to the library once and remembers its ids."""

    def __init__(self, path: str, by_word: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of these texts (an array of bytes)."""
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.string())
        if not self.by_word:
            return [np.array(x, np.uint32) for x in self.plain(texts.to_pylist())]
        if len(self.codes) > REMEMBERED:
            self.forget()
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        distinct, known = words.dictionary.to_pylist(), self.codes
        new = [w for w in distinct if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        ids = self.plain(new)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        size = self.sizes[at]
        flat = self.flat[ragged((np.cumsum(self.sizes) - self.sizes)[at], size)]
        ends = np.append(0, np.cumsum(size))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [flat[lo:hi] for lo, hi in zip(ends, ends[1:])]


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin here and have these sizes, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


@lru_cache(maxsize=4)
def encoder(path: str, by_word: bool) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, by_word)


INDEX = "part int, file string, record bigint, offset bigint, length bigint, n_ids bigint"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int | None = END, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the documents' ids, in ascending order of the identifier, to files under ``folder``/data; returns the index, which
    is at ``folder``/index: part (the range), file, record (its number in the file), offset, length and n_ids, and start (the
    ids of all records before it)."""
    entries = encoder(tokenizer_path, by_word).tokenizer.get_vocab_size()  # mistakes show here, not in a task
    width = 2 if max(entries, end or 0) <= 1 << 16 else 4
    spark, out = docs.sparkSession, to_arrow_schema(StructType.fromDDL(INDEX + ", before bigint"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(size / min(range_bytes, max(LEAST_BYTES, size // TASKS))))
    hashed = F.xxhash64("t")  # parts rows with the same identifier
    rows = rows.repartitionByRange(ranges, F.asc_nulls_first("id"), hashed).sortWithinPartitions(F.asc_nulls_first("id"), hashed, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        fs.create_dir(base)
        own, n_files, sink, name, offset, record = uuid.uuid4().hex, 0, None, "", 0, 0
        try:
            for b in (piece for whole in batches for piece in slices(whole, 1, TOGETHER)):
                ids = encoder(tokenizer_path, by_word).encode(b.column(1))
                ids = [x if end is None else np.append(x, np.uint32(end)) for x in ids]
                frames = framed([payload(k, x, width) for k, x in zip(b.column(0).to_pylist(), ids)])
                made = []
                for f, x in zip(frames, ids):
                    if sink is None or offset and offset + len(f) > file_bytes:
                        if sink is not None:
                            sink.close()
                        name, offset, record = f"{part:07d}-{n_files:05d}-{own}.records", 0, 0
                        n_files, sink = n_files + 1, fs.open_output_stream(f"{base}/{name}")
                    sink.write(f)
                    made.append((part, name, record, offset, len(f), len(x), before))
                    offset, record, before = offset + len(f), record + 1, before + len(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), out)], schema=out)
        finally:
            if sink is not None:
                sink.close()

    named = rows.select(F.col("id").cast("string"), "t").mapInArrow(run, INDEX + ", before bigint")
    index = written(named, "records-index")
    # A row for each range: those before it in its thousand, and the thousands before.
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.expr("part div 1000"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", earlier(Window.orderBy("block")).alias("o"))
    parts = parts.select("part", "block", earlier(Window.partitionBy("block").orderBy("part")).alias("p")).join(blocks, "block").select("part", (F.col("o") + F.col("p")).alias("base"))
    index = index.join(parts, "part").select(*[c.split()[0] for c in INDEX.split(", ")], (F.col("base") + F.col("before")).alias("start"))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX + ", start bigint").parquet(f"{folder}/index")


READ = "file string, record bigint, start bigint, id {}, ids array<int>, ids_crc32 bigint"


def _read_rows(frames: list[bytes], name: str, records: list[int], starts: list[int]) -> pa.RecordBatch:
    got = [parsed(p) for p in unframed(frames, name)]
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for _, x in got]]), pa.int32()), pa.array(np.concatenate([x for _, x in got]).astype(np.int32)))
    columns = [pa.array([name] * len(got)), pa.array(records, pa.int64()), pa.array(starts, pa.int64()), pa.array([k for k, _ in got], pa.string()), ids, pa.array([zlib.crc32(x.tobytes()) for _, x in got], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "record", "start", "id", "ids", "ids_crc32"])


def read(index: DataFrame, folder: str, id_type: str = "bigint", batch_bytes: int = 4 << 20) -> DataFrame:
    """The records that these rows of the index name, in their order within partitions: file, record, start, id, ids and
    ids_crc32 (of the ids as bytes).  A damaged record is a ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        for b in batches:
            rows, k = b.to_pydict(), 0
            while k < b.num_rows:  # rows of one file, up to batch_bytes
                name, first, size = rows["file"][k], k, 0
                with fs.open_input_file(f"{base}/{name}") as f:
                    frames = []
                    while k < b.num_rows and rows["file"][k] == name and (not frames or size + rows["length"][k] <= batch_bytes):
                        frames.append(f.read_at(rows["length"][k], rows["offset"][k]))
                        size, k = size + rows["length"][k], k + 1
                yield _read_rows(frames, name, rows["record"][first:k], rows["start"][first:k])

    got = index.select("file", "record", "offset", "length", "start").mapInArrow(run, READ.format("string"))
    return got.withColumn("id", F.col("id").cast(id_type))


def read_files(index: DataFrame, folder: str, id_type: str = "bigint", batch_bytes: int = 4 << 20) -> DataFrame:
    """The same for whole files, each read by one task from its beginning to its end by the lengths in the records alone; the
    index only names the files and what comes before each.  A file that has other records than the index is a ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/data")
        for b in batches:
            for row in b.to_pylist():
                record, start, frames, size = 0, row["start"], [], 0
                with fs.open_input_stream(f"{base}/{row['file']}", buffer_size=1 << 20) as f:
                    while True:
                        head = f.read(12)
                        if frames and (not head or size >= batch_bytes):
                            got = _read_rows(frames, row["file"], list(range(record, record + len(frames))), [0] * len(frames))
                            n = np.diff(got.column(4).offsets.to_numpy())
                            starts = start + np.cumsum(n) - n
                            yield got.set_column(2, "start", pa.array(starts, pa.int64()))
                            record, start, frames, size = record + len(frames), start + int(n.sum()), [], 0
                        if not head:
                            break
                        n = int.from_bytes(head[:8], "little") if len(head) == 12 else -1
                        if n < 0 or n > row["bytes"]:
                            raise ValueError(f"record {record + len(frames)} of {row['file']} is damaged")
                        frames.append(head + f.read(n + 4))
                        size += n + 16
                if (record, start) != (row["records"], row["start"] + row["n_ids"]):
                    raise ValueError(f"{row['file']} doesn't hold the records of its index")

    files = index.groupBy("file").agg(F.min("start").alias("start"), F.count("*").alias("records"), F.sum("n_ids").alias("n_ids"), F.sum("length").alias("bytes"))
    # Spark would join so short a list into one task.
    got = files.repartition(min(MOST_READERS, max(1, files.count()))).mapInArrow(run, READ.format("string"))
    return got.withColumn("id", F.col("id").cast(id_type))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "token-records")
    index = write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    got = read_files(index, folder, kind(docs, "doc_id"))
    return got.select(F.col("id").alias("doc_id"), "start", F.size("ids").cast("bigint").alias("n_tokens"), "ids_crc32")
