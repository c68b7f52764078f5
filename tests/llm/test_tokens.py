"""Token records, alignment of tokens and periodic runs against plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import alignment, periods, records, registry
from muster.llm.common import coded, scratch, table

SF = "/root/testdata/sf0.01"
WORDS, A, B = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b\n\nc  d ", "\n a", "\t", "é😀 née", "a▁b", "a ▁ b", "<0x41> <s> <unk> <|endoftext|> </s>", "x" * 5000, "ab" * 3000, " " * 4000 + "a", "-" * 3000, "é" * 900,
    "\x00\x01\x1f \x85 \xa0x", "Ａ ﬁ é", "漢字 かな交じり文 " * 50, "it's we'll I'd'", "12345678 12,5 1/2", "a\r\nb\x0bc\x0cd", "̀a ́b",
]


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return dict(zip(t.doc_id, t.text))


@pytest.fixture(scope="module")
def odd_texts(spark):
    return spark.createDataFrame([*enumerate(ODD)], "doc_id bigint, text string").repartition(3)


# --- records


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums_of_the_standard():
    """Values that the definition of iSCSI (RFC 3720, B.4) gives."""
    known = {bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E, bytes(range(31, -1, -1)): 0x113FDB5C}
    words = np.frombuffer(b"".join(known), "<u4")
    assert records.crc32c(words, np.full(4, 8)).tolist() == [*known.values()]


@given(st.lists(st.binary(max_size=200).map(lambda b: b[: len(b) // 4 * 4]), max_size=8))
@settings(deadline=None)
def test_checksums(parts):
    got = records.crc32c(np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64))
    assert got.tolist() == [crc32c(p) for p in parts]


@given(st.lists(st.tuples(st.none() | st.text(max_size=9), st.lists(st.integers(0, 49407), max_size=9)), min_size=1, max_size=5))
@settings(deadline=None)
def test_frames(rows):
    frames = records.framed([records.payload(k, np.array(ids, np.uint32)) for k, ids in rows])
    for f in frames:
        n, a = struct.unpack_from("<QI", f)
        mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
        assert n == len(f) - 16 and a == mask(crc32c(f[:8])) and struct.unpack("<I", f[-4:])[0] == mask(crc32c(f[12:-4]))
    assert [(k, ids.tolist()) for k, ids in map(records.parsed, records.unframed(frames, "here"))] == [(k, ids) for k, ids in rows]
    for at in range(len(frames[0])):
        with pytest.raises(ValueError, match="damaged"):
            records.unframed([frames[0][:at] + bytes([frames[0][at] ^ 64]) + frames[0][at + 1 :]], "here")


def plain_records(rows):
    t, want, before = Tokenizer.from_file(WORDS), [], 0
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, records.END]
        want.append((k, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return want


def test_records_of_all_documents(spark, texts):
    got = registry.queries()["op11_token_records"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == plain_records(sorted(texts.items()))


def test_records_of_odd_texts(spark, odd_texts):
    folder = scratch(spark, "records")
    index = records.write(odd_texts, folder, WORDS, file_bytes=10_000, range_bytes=20_000)
    got = records.read_files(index, folder)
    assert sorted((r.id, r.start, len(r.ids), r.ids_crc32) for r in got.collect()) == plain_records([*enumerate(ODD)])
    assert index.select("file").distinct().count() > 2


def test_files_hold_documents_in_order(spark, texts):
    folder = scratch(spark, "records")
    index = records.write(table(spark, SF, "documents"), folder, WORDS, file_bytes=200_000, range_bytes=1 << 20)
    rows = sorted(records.read_files(index, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted(texts) and len({r.file for r in rows}) > 8
    assert [(r.file, r.record) for r in rows] == sorted((r.file, r.record) for r in rows)


def test_shuffled_reads(spark, texts):
    """Any rows of the index in any order."""
    folder = scratch(spark, "records")
    index = records.write(table(spark, SF, "documents"), folder, WORDS, file_bytes=200_000)
    some = index.filter("record % 3 = 1").orderBy(F.md5(F.concat("file", "record")))
    rows = {(r.file, r.record): r for r in records.read_files(index, folder).collect()}
    got = records.read(some, folder, batch_bytes=1000).collect()
    assert len(got) == some.count() > 100 and all(rows[r.file, r.record] == r for r in got)


def test_damaged_files_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some text " * k) for k in range(20)], "doc_id bigint, text string")
    index = records.write(docs, f"file://{tmp_path}", WORDS)
    file = tmp_path / "data" / index.first()["file"]
    data = bytearray(file.read_bytes())
    for damage in (data[:40] + b"\x03" + data[41:], data[:-3], data[: index.agg(F.max("offset")).first()[0]]):
        file.write_bytes(damage)
        with pytest.raises(Exception, match="damaged|doesn't hold"):
            records.read_files(index, f"file://{tmp_path}").collect()
    file.write_bytes(data)
    assert records.read_files(index, f"file://{tmp_path}").count() == 20


def test_records_with_odd_rows(spark, odd, nothing):
    folder = scratch(spark, "records")
    got = sorted(records.read_files(records.write(odd, folder, WORDS), folder).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8] and got[2].ids == got[3].ids == [records.END]
    folder = scratch(spark, "records")
    index = records.write(nothing, folder, WORDS)
    assert index.collect() == [] and records.read_files(index, folder).collect() == [] and records.read(index, folder).collect() == []


def test_records_of_a_crowded_identifier(spark):
    """A third of all rows without an identifier, in any order of the input."""
    rows = [(None if k % 3 else k, f"text {k} " * (k % 7)) for k in range(300)]
    found = []
    for n in (1, 7):
        folder = scratch(spark, "records")
        index = records.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), folder, WORDS, range_bytes=1000)
        found.append([(r.id, r.start, r.ids) for r in records.read_files(index, folder).orderBy("start").collect()])
    assert found[0] == found[1] and len(found[0]) == 300
    assert [k for k, *_ in found[0]] == [None] * 200 + [k for k in range(300) if k % 3 == 0]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    folder = scratch(spark, "records")
    want = Tokenizer.from_file(WORDS).encode("a�b", add_special_tokens=False).ids
    assert records.read_files(records.write(docs, folder, WORDS), folder).first().ids == [*want, records.END]
    row = alignment.align(docs, A, B).first()
    assert (row.n_a, row.n_b, row.n_groups, row.groups_sha256) == (0, 0, 0, "")
    assert periods.periodic_runs(docs).first().collapsed == b"a\xffb"


# --- alignment


def token_bytes():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars = {c: chr(c) for c in plain}
    for c in range(256):
        chars.setdefault(c, chr(256 + len(chars) - len(plain)))
    back = {v: k for k, v in chars.items()}
    pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
    of_b = lambda p: bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode()
    names = {k: t for t, k in a.get_vocab(with_added_tokens=False).items()}
    return a, b, lambda k: bytes(back[c] for c in names[k]), lambda k: of_b(pieces[k])


def plain_alignment(rows):
    a, b, bytes_a, bytes_b = token_bytes()
    out, linked = [], []
    for _, text in rows:
        groups = []
        if text:
            want = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb, yb = [*map(bytes_a, x)], [*map(bytes_b, y)]
            if b"".join(xb) == b"".join(yb) == want:
                xe, ye = np.cumsum([*map(len, xb)]).tolist(), np.cumsum([*map(len, yb)]).tolist()
                cuts = {e: g for g, e in enumerate(sorted(set(xe) & set(ye)))}
                groups = [([], []) for _ in cuts]
                for side, (ids, ends) in enumerate(((x, xe), (y, ye))):
                    g = 0
                    for k, e in zip(ids, ends):
                        groups[g][side].append(k)
                        g = cuts[e] + 1 if e in cuts else g
        out.append(groups)
        linked.append(Counter((p, q) for g in groups for p in g[0] for q in g[1]))
    counts = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    want = []
    for (k, _), groups, links in zip(rows, out, linked):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_best = sum(n for p, n in links.items() if counts[p] == best[p[0]])
        want.append((k, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), n_best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return want


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_all_documents(spark, texts):
    got = registry.queries()["op12_token_alignment"](spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain_alignment(sorted(texts.items()))


@pytest.mark.parametrize("chunk, most_pairs", [(1, 256), (200, 256), (200, 0), (alignment.CHUNK_BYTES, 256)])
def test_alignment_of_odd_texts(spark, odd_texts, monkeypatch, chunk, most_pairs):
    """In chunks of one text, of some and of all; counts go over all of them."""
    monkeypatch.setattr(alignment, "MOST_PAIRS", most_pairs)
    monkeypatch.setattr(alignment, "slices", lambda b, text, most, cut=alignment.slices, chunk=chunk: cut(b, text, chunk))
    assert sorted(map(tuple, alignment.align(odd_texts, A, B).collect())) == plain_alignment([*enumerate(ODD)])


def test_alignment_with_odd_rows(spark, odd, nothing):
    assert alignment.align(nothing, A, B).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    low = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(low, map(tuple, alignment.align(odd, A, B).collect()))) == sorted(map(low, plain_alignment(rows)))


def test_ids_that_repeat_in_a_group(monkeypatch):
    """A group with m and n equal tokens has m n links of one pair; it is counted without listing them."""
    import duckdb

    db = duckdb.connect()
    db.sql("CREATE TABLE ag AS SELECT 0 AS doc, i % 2 AS id, i AS lo, 1 AS g FROM range(3000) t(i)")
    db.sql("CREATE TABLE bg AS SELECT 0 AS doc, 7 AS id, i AS lo, 1 AS g FROM range(2000) t(i)")
    for sql in (alignment.LINKS_OF_LARGE, alignment.LINKS):
        db.execute(sql)
        assert sorted(db.sql("FROM links").fetchall()) == [(0, 0, 7, 3_000_000), (0, 1, 7, 3_000_000)]


# --- periodic runs


def plain_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                s = w[i : j + q]
                if not any(s[r:] == s[:-r] for r in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 60), rng.randint(1, 4)
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least, times", [(1, 2), (6, 3), (24, 3)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(300):
        batch = [some_words(rng) for _ in range(rng.randint(1, 5))]
        got = periods.runs([np.array(w, np.int64) for w in batch], least, times)
        assert [[*map(tuple, g.tolist())] for g in got] == [plain_runs(w, least, times) for w in batch]


def test_smaller_halves():
    """A position is looked at O(log n) times: of 60,000 words with period 7 not even once for each of the 20,000 levels."""
    seen = []
    classes = periods.Classes([np.arange(60_000) % 7], 3)
    split = classes.split
    classes.split = lambda level: (seen.append(len(classes.small)), split(level))
    classes.refine()
    assert 10_000 < len(seen) and sum(seen) < 60_000 * 3


def query_row(k, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(k).encode()), len(w)
    if k is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(coded(w).tolist())
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (k, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_of_all_documents(spark, small):
    """Also of copies of documents with periodic words of their own."""
    t = pq.read_table(f"{small}/documents.parquet").to_pandas()
    docs = {k: x for k, x in zip(t.doc_id, t.text) if len(x) < 20_000}
    more = {10_000 + k: " ".join(["zz", *(x.split()[:5] * 6), *x.split()[:30], *(["na"] * 40)]) for k, x in docs.items()}
    rows = [*(docs | more).items()]
    got = periods.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(query_row(k, x) for k, x in rows)


def test_runs_with_odd_rows(spark, odd, nothing):
    assert periods.digests(nothing).collect() == []
    rows = [r for r in odd.collect() if r.doc_id != 5]
    low = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(low, map(tuple, periods.digests(odd.filter("doc_id IS NULL OR doc_id != 5")).collect()))) == sorted(low(query_row(r.doc_id, r.text)) for r in rows)
    long = periods.periodic_runs(odd.filter("doc_id = 5")).first()
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 3)] and long.collapsed == b"lorem ipsum dolor"


@pytest.mark.parametrize("name", ["records", "alignment", "periods"])
def test_clashing_names(spark, odd, name):
    names = ("id", "k", "t", "part", "file", "record", "offset", "start", "length", "n_ids", "chunk", "pair", "times", "pairs", "total", "best", "a", "b", "g", "n", "runs", "collapsed", "n_words", "before", "base", "block")
    docs = odd.select("doc_id", "text", *[F.lit("x").alias(c) for c in names])

    def result(d):
        if name == "records":
            folder = scratch(spark, "records")
            return records.read_files(records.write(d, folder, WORDS), folder).drop("file")
        return alignment.align(d, A, B) if name == "alignment" else periods.periodic_runs(d)

    assert sorted(map(str, result(docs).collect())) == sorted(map(str, result(odd).collect()))
