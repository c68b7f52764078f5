"""Convert uploaded files to tables of strings: CSV, XLSX, JSON, XML, and tables that were recognised in documents.

Spark reads the bytes by its own file systems.  JSON and XML are read by tasks that each take the records of a part of the file;
a workbook, and what these ways can't tell, is parsed by a task as a whole.
"""

from __future__ import annotations

import io
import json
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import quoted
from ..errors import ConfigurationError, IngestionError, ValidationError
from . import parts
from .csv import Location, checked_filename, read_csv, stem

DOCUMENTS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif")
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Number formats of the file format that show dates or times; rows that a task hands on, and parses, at once.
BUILT_IN_DATES, ROWS, TOGETHER = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}, 4096, 256
#: Bytes of a sheet that are unpacked at once; of a workbook for which a task more takes part, and tasks at most.
PIECE, PART_BYTES, MOST_PARTS = 1 << 20, 8 << 20, 16
ROW, NUMBER, PREFIXED = re.compile(rb"<row(?:\s[^>]*)?(?<!/)>.*?</row>|<row(?:\s[^>]*)?/>", re.S), re.compile(rb'<row\s[^>]*?\br="(\d+)"'), re.compile(rb"\s[\w.\-]+:[\w.\-]+=(?:\"[^\"]*\"|'[^']*')")
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def needs_recognition(name: str) -> bool:
    return extension(name) in DOCUMENTS


def is_csv(name: str) -> bool:
    return extension(name) == "csv"


def csv_names(spark: SparkSession, path: str) -> list[str]:
    """A quick look at the first line: split at commas, without quotes and empty names."""
    line = spark.read.text(path).limit(1).collect()
    names = [n for n in (x.strip().strip('"') for x in (line[0][0] if line else "").split(",")) if n]
    if not names:
        raise ValidationError(f"{path} has no header")
    return names


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def date_styles(styles: bytes) -> set[int]:
    """Cell styles whose number format shows dates: the built-in ones, and own ones with a letter of a date outside quotes."""
    root = ET.fromstring(styles)
    own = {f.get("numFmtId"): f.get("formatCode") or "" for f in root.iter(f"{SHEET}numFmt")}
    formats = [x.get("numFmtId") or "0" for x in root.iterfind(f"{SHEET}cellXfs/{SHEET}xf")]
    shows = lambda n: bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[n]).lower())) if n in own else int(n) in BUILT_IN_DATES
    return {k for k, n in enumerate(formats) if shows(n)}


def iso_date(x: float, from_1904: bool) -> str:
    """The date, or the date-time to a second, of a stored number."""
    at = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if x >= 60 else datetime(1899, 12, 31)
    at += timedelta(seconds=round(x * 86400))
    return at.isoformat(" ") if x % 1 else at.date().isoformat()


class Texts:
    """Shared strings of a workbook: one run of bytes and where each begins."""

    def __init__(self, entry: object | None) -> None:
        self.data, self.ends = bytearray(), array("Q", [0])
        for _, si in ET.iterparse(entry) if entry else ():
            if si.tag == f"{SHEET}si":
                self.data += "".join(t.text or "" for t in si.iter(f"{SHEET}t")).encode()
                self.ends.append(len(self.data))
                si.clear()

    def __getitem__(self, k: int) -> str:
        return self.data[self.ends[k] : self.ends[k + 1]].decode()


def _column(reference: str | None) -> int | None:
    """The column's number of a cell's name: AB12 is 27."""
    if not (m := re.match("[A-Z]+", reference or "")):
        return None
    at = 0
    for ch in m[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _cells(row: ET.Element, shared: Texts, dates: set[int], from_1904: bool) -> list[str]:
    """A row's cells as text; gaps are empty."""
    found: dict[int, str] = {}
    for at, c in enumerate(row.iter(f"{SHEET}c")):
        v, kind = c.findtext(f"{SHEET}v") or "", c.get("t", "n")
        if kind == "s":
            v = shared[int(v)]
        elif kind == "inlineStr":
            v = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
        elif kind == "b":
            v = "true" if v == "1" else "false"
        elif kind == "e":
            v = f"#ERR:{v}"
        elif kind == "n" and v:
            v = iso_date(float(v), from_1904) if int(c.get("s") or 0) in dates else number_text(float(v))
        own = _column(c.get("r"))
        found[at if own is None else own] = v
    return [found.get(k, "") for k in range(max(found, default=-1) + 1)]


def _row_texts(entry: object) -> Iterator[bytes]:
    """The row elements of a sheet, one after the other; only one piece of the sheet is held."""
    held, ended = b"", False
    while not ended:
        piece = entry.read(PIECE)
        ended, held, at = not piece, held + piece, 0
        for m in ROW.finditer(held):
            yield m[0]
            at = m.end()
        begins = held.find(b"<row", at)
        held = held[begins:] if begins >= 0 else held[-4:] if not ended else b""


def sheet_rows(data: bytes, sheet: int, iso_dates: bool = False, part: int = 0, parts: int = 1) -> Iterator[tuple[int, list[str]]]:
    """Numbers and cells of a sheet's rows; gaps are rows without cells.

    The sheet is unpacked piece by piece.  Of ``parts`` tasks that all unpack it, each takes every parts-th stretch of
    ``ROWS`` rows; the others' rows are not taken apart."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        sheets = [x.get(RELATION) for x in book.iter(f"{SHEET}sheet")]
        if sheet >= len(sheets):
            raise ConfigurationError(f"the workbook has {len(sheets)} sheet(s) but table_index is {sheet}")
        targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = Texts(z.open("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else None)
        dates = date_styles(z.read("xl/styles.xml")) if iso_dates and "xl/styles.xml" in z.namelist() else set()
        from_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter(f"{SHEET}workbookPr"))
        target = targets[sheets[sheet]]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(name) as entry:
            prefixed = re.search(rb"<\w+:worksheet", entry.read(4096)) is not None
        last, held = 0, []
        with z.open(name) as entry:
            if prefixed:
                rows = ((int(x.get("r") or 0), x) for _, x in ET.iterparse(entry) if x.tag == f"{SHEET}row")
            else:
                rows = ((int(m[1]) if (m := NUMBER.match(x)) else 0, x) for x in _row_texts(entry))
            for k, (number, row) in enumerate(rows):
                number = number or last + 1
                if k // ROWS % parts == part:
                    if prefixed:
                        yield from ((n, []) for n in range(last + 1, number))
                        yield number, _cells(row, shared, dates, from_1904)
                        row.clear()
                    else:
                        held.append((last, number, row))
                if len(held) == TOGETHER or held and k // ROWS % parts != part:
                    yield from _parsed(held, shared, dates, from_1904)
                    held = []
                last = max(last, number)
            yield from _parsed(held, shared, dates, from_1904)


def _parsed(rows: list[tuple[int, int, bytes]], shared: Texts, dates: set[int], from_1904: bool) -> Iterator[tuple[int, list[str]]]:
    """Numbers and cells of rows, each with the last number before it; gaps are rows without cells."""
    elements = ET.fromstring(b'<x xmlns="' + SHEET[1:-1].encode() + b'">' + PREFIXED.sub(b"", b"".join(r for _, _, r in rows)) + b"</x>")
    for (last, number, _), element in zip(rows, elements):
        yield from ((n, []) for n in range(last + 1, number))
        yield number, _cells(element, shared, dates, from_1904)


def json_text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def json_rows(data: bytes, table: int) -> Iterator[list[str]]:
    """Objects of the root array, or of the table-th shortest array in the root object; columns are the first object's, sorted."""
    root = json.loads(data)
    if isinstance(root, dict):
        arrays = sorted((root[k] for k in sorted(root) if isinstance(root[k], list)), key=len)
        if table >= len(arrays):
            raise ConfigurationError(f"the root object has fewer than {table + 1} array(s)")
        root = arrays[table]
    if not isinstance(root, list):
        raise ValidationError("the root must be an array, or an object that holds arrays")
    if not root or not isinstance(root[0], dict):
        raise ValidationError("the array holds no objects")
    names = sorted(root[0])
    yield names
    for x in root:
        yield [json_text(x.get(n) if isinstance(x, dict) else None) for n in names]


def xml_fields(record: ET.Element) -> dict[str, str]:
    """Texts of a record's children; those of the same name are joined, unless they are what is there already."""
    row: dict[str, str] = {}
    for f in record:
        name = f.tag.rpartition("}")[2]
        for t in map(str.strip, f.itertext()):
            if t:
                had = row.get(name)
                row[name] = t if had is None or had == t else f"{had} {t}"
    return row


def xml_rows(data: bytes, table: int) -> Iterator[list[str]]:
    """Records are the most frequent children of the root (the first of equals), fields their children."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise IngestionError(f"XML parse error: {e}") from e
    local = lambda x: x.tag.rpartition("}")[2]
    children = [c for c in root if len(c) or (c.text or "").strip()]
    if not children:
        raise ValidationError("the document has no repeated records")
    record = Counter(map(local, children)).most_common(1)[0][0]
    rows, names = [], {}
    for c in children:
        if local(c) != record:
            continue
        row = xml_fields(c)
        names |= dict.fromkeys(row)
        rows.append(row)
    yield list(names)
    for row in rows:
        yield [row.get(n, "") for n in names]


def _first_character(spark: SparkSession, path: str) -> str:
    """The first that is no white space, of at most 4,096 that are looked at."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return next((c for c in (chr(b) for b in (file.read() for _ in range(4096)) if b >= 0) if c not in " \t\r\n\xef\xbb\xbf"), "")
    finally:
        file.close()


def _variant_text(v: Column) -> Column:
    """As ``json_text`` has it: texts as they are, null as nothing, other values as JSON with sorted keys."""
    return F.coalesce(F.when(F.is_variant_null(v), F.lit("")).when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v)), F.lit(""))


def json_table(spark: SparkSession, path: str, table: int) -> DataFrame | None:
    """What ``json_rows`` makes of a file, by tasks that each read a part of it.  None for files that this can't be told of: the
    parser then names what is wrong.

    Values are variants, each with a bounded size; neither the file nor its arrays have one."""
    root = next((c for f in parts.files(spark, path) if (c := _first_character(spark, f["path"]))), "")
    found = parts.json_elements(spark, path, root, table) if root in ("[", "{") else None
    if found is None or not all(re.fullmatch(r"[^`'\\\]]+", n) for n in found[0]):
        return None
    names, elements = found
    rows = elements.select(F.from_json("text", ", ".join(f"`{n}` variant" for n in names)).alias("v"))
    return rows.select(*[_variant_text(F.col(f"v.`{n}`")).alias(n) for n in names])


#: What a file that is cut at the ends of its records mustn't hold: marks in which anything may stand.
ODD = (b"<![CDATA[", b"<!--", b"<!DOCTYPE", b"<!ENTITY")


TAG = re.compile(rb"<(/?)((?:[\w.\-]+:)?[\w.\-]+)([^<>]*)>")
TAGS = "file bigint, block bigint, name string, depth bigint, n bigint, first bigint, empty boolean, odd boolean"


def _tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the elements that open, by depth (from the block's begin) and name; a row without a name says by how much the
    depth changes, how many bytes there are, and whether a tag is open at its end (``empty``)."""
    seen: dict[tuple[int, int], list] = {}

    def take(s: list, data: bytes) -> None:
        s[1] |= any(x in data for x in ODD)
        for m in TAG.finditer(data):
            close, name, rest = m.groups()
            if close:
                s[0] -= 1
                continue
            own = s[4].setdefault((name, s[0]), [0, len(s[4]), False])
            own[0] += 1
            if rest:
                s[1] |= bool(rest.count(b"'") % 2 or rest.count(b'"') % 2)
            if rest.endswith(b"/"):
                own[2] = True
            else:
                s[0] += 1

    for key, data in parts.stretches(batches, b">"):
        s = seen.setdefault(key, [0, False, 1, b"", {}])
        s[2] += len(data)
        whole = s[3] + data
        end = whole.rfind(b">") + 1
        take(s, whole[:end])
        s[3] = whole[end:]
    for key, s in seen.items():
        take(s, s[3] + b">")
        found = [(*key, None, s[0], s[2], 0, b"<" in s[3], s[1]), *((*key, name.decode(), depth, *own, False) for (name, depth), own in s[4].items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.bool_()))], names=[x.split()[0] for x in TAGS.split(", ")])


def _record(listed: list, told: list) -> str | None:
    """The name of the root's most frequent children, if files can be cut after each of them."""
    blocks = parts.in_order(listed, [{**r.asDict(), "bytes": r["n"]} for r in told if r["name"] is None])
    follows = parts.ended(listed, blocks)
    if not follows or any(b["odd"] for b in blocks):
        return None
    depth, base = 0, {}
    for k, b in enumerate(blocks):
        first, last = not k or blocks[k - 1]["file"] != b["file"], k + 1 == len(blocks) or blocks[k + 1]["file"] != b["file"]
        if first and depth > 1 or last and b["empty"] and not follows[b["file"]]:  # an element, or a tag, lies in two files
            return None
        base[b["file"], b["block"]] = k, depth
        depth += b["depth"]
    names: dict[str, dict] = {}
    for r in told:
        if r["name"] is not None:
            at, begin = base[r["file"], r["block"]]
            x = names.setdefault(r["name"], {"n": 0, "all": 0, "first": (at, r["first"]), "empty": False})
            x["n"] += r["n"] if begin + r["depth"] == 1 else 0
            x["all"] += r["n"]
            x["first"], x["empty"] = min(x["first"], (at, r["first"])), x["empty"] or r["empty"]
    if depth or not names:
        return None
    record, most = min(names.items(), key=lambda x: (-x[1]["n"], x[1]["first"]))
    local = lambda x: x.rpartition(":")[2]
    top = {local(k): x["n"] for k, x in names.items() if x["n"]}
    if not most["n"] or most["all"] != most["n"] or most["empty"] or Counter(map(local, names))[local(record)] > 1 or [*top.values()].count(most["n"]) > 1:
        return None
    return record


def xml_table(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``xml_rows`` makes of a file, by tasks that each read a part of it: Spark's text reader cuts the file at every
    ``>`` to count the root's children, and at the end of every record to parse records.  None for files that can't be cut so:
    with comments and the like, records in records, one name with several prefixes, or uploads with a record in two of their parts."""
    listed = parts.files(spark, path)
    record = _record(listed, parts.pieces(spark, path, ">").mapInArrow(_tags, TAGS).collect())
    if record is None:
        return None
    pieces = parts.pieces(spark, path, f"</{record}>").select(F.monotonically_increasing_id().alias("k"), "value", "file", "block")
    pieces = pieces.filter(F.rlike("value", F.lit(rf"<{re.escape(record)}[\s>]")))
    begin, tag = re.compile(rf"<{re.escape(record)}(?=[\s>])[^<>]*>"), re.compile(r"<(/?)(?:[\w.\-]+:)?([\w.\-]+)[^<>]*?(/?)>")

    def records(b: pa.RecordBatch) -> list[list | None]:
        """The fields of each record; None for those without any content."""
        rows = []
        for text in b.column(1).to_pylist():
            try:
                element = ET.fromstring(f"<r>{tag.sub(r'<\1\2\3>', text[begin.search(text).end() :])}</r>")
            except ET.ParseError as e:
                raise IngestionError(f"XML parse error: {e}") from e
            rows.append([*xml_fields(element).items()] if len(element) or (element.text or "").strip() else None)
        return rows

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(records(b), pa.map_(pa.string(), pa.string()))], names=["fields"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each name is first in a task's blocks."""
        seen: dict[tuple, tuple] = {}
        for b in batches:
            for k, file, block, row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), records(b)):
                for j, (name, _) in enumerate(row or ()):
                    seen[file, name] = min(seen.get((file, name), (block, k, j)), (block, k, j))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*x, *at) for x, at in seen.items()])], names=["file", "name", "block", "k", "j"])

    found, at = pieces.mapInArrow(look, "file bigint, name string, block bigint, k bigint, j bigint").collect(), {f["file"]: k for k, f in enumerate(listed)}
    names = dict.fromkeys(r["name"] for r in sorted(found, key=lambda r: (at[r["file"]], r["block"], r["k"], r["j"])))
    rows = pieces.mapInArrow(parse, "fields map<string,string>").filter(F.col("fields").isNotNull())
    return rows.select(*[F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")).alias(n) for n in names])


PARSERS = {"json": json_rows, "xml": xml_rows}


def convert(spark: SparkSession, path: str, table_index: int = 0, iso_dates: bool = False) -> DataFrame:
    """The table in a file by the file's extension; all columns are strings.  JSON and XML may also come in parts, as a folder.

    Dates in workbooks are the numbers that they are stored as; with iso_dates, ISO dates or date-times."""
    kind = extension(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "xls":
        raise ConfigurationError("legacy .xls workbooks are not supported; save the file as .xlsx")
    if kind == "xlsx":
        return xlsx_table(spark, path, table_index, iso_dates)
    if kind not in PARSERS:
        raise ConfigurationError(f"files of type '{kind}' cannot be converted")
    own = json_table(spark, path, table_index) if kind == "json" else xml_table(spark, path)
    if own is not None:
        return own
    parse, out = PARSERS[kind], pa.schema([("k", pa.int64()), ("cells", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = b"".join(x["content"] for x in sorted((x for b in batches for x in b.to_pylist()), key=lambda x: x["path"]))
        yield from _batches(enumerate(parse(whole, table_index)), out)

    cells = spark.read.format("binaryFile").load(path).select("path", "content").coalesce(1).mapInArrow(rows, "k bigint, cells array<string>")
    names = _unique(cells.filter("k = 0").collect()[0]["cells"], path)
    return cells.filter("k > 0").select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)


def _unique(names: list[str], path: str) -> list[str]:
    if len(set(names)) != len(names):
        raise ConfigurationError(f"{path} has repeated column names: {', '.join(names)}")
    return names


def xlsx_table(spark: SparkSession, path: str | list[str], sheet: int = 0, iso_dates: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """A workbook's sheet, or the rows of several workbooks with the same header; the first row with cells is a sheet's header.

    Tasks each read some of the workbooks; large ones are read by several tasks."""
    file, out = spark.read.format("binaryFile").load(path), pa.schema([("book", pa.int64()), ("k", pa.int64()), ("cells", pa.list_(pa.string()))])
    parts = min(MOST_PARTS, max(1, math.ceil(file.agg(F.max("length")).first()[0] / part_bytes)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for book, part, data in (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns)):
            yield from _batches(((book, *row) for row in sheet_rows(data, sheet, iso_dates, part, parts)), out)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The width of each workbook's part, and its first row with cells."""
        for b in batches:
            for book, part, data in zip(*[c.to_pylist() for c in b.columns]):
                width, head = 0, (None, None)
                for k, cells in sheet_rows(data, sheet, iso_dates, part, parts):
                    width, head = max(width, len(cells)), (k, cells) if cells and not width else head
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((book, width, *head), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["book", "width", "k", "cells"])

    each = reduce(DataFrame.union, [file.select(F.xxhash64("path").alias("book"), F.lit(k).alias("part"), "content") for k in range(parts)])
    cells = each.mapInArrow(rows, "book bigint, k bigint, cells array<string>")
    seen, heads = each.mapInArrow(look, "book bigint, width bigint, k bigint, cells array<string>").collect(), {}
    for r in seen:
        heads[r["book"]] = min((x for x in (heads.get(r["book"]), r["k"] and (r["k"], r["cells"])) if x), default=None)
    if not heads or not all(heads.values()):
        raise ValidationError("the sheet is empty")
    headers, width = {tuple(cells) for _, cells in heads.values()}, max(r["width"] for r in seen)
    if len(headers) > 1:
        raise ConfigurationError(f"the workbooks have {len(headers)} different headers")
    names = [*headers.pop()]
    names += [""] * (width - len(names))
    if not any(names):
        raise ValidationError("the sheet's header has no column names")
    _unique(names, str(path))
    first = {k for k, _ in heads.values()}
    if len(first) > 1:
        after = spark.createDataFrame([(book, k) for book, (k, _) in heads.items()], "book bigint, head bigint")
        cells = cells.join(F.broadcast(after), "book").filter("k > head")
    return cells.filter(F.col("k") > min(first)).select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def prepare_source(spark: SparkSession, location: Location, uploaded: str, table_index: int = 0, iso_dates: bool = False) -> tuple[str, list[str]]:
    """What an upload needs before it can be a source: ('not_needed', names) for CSV; else the table is written beside it."""
    name = checked_filename(uploaded.rpartition("/")[2])
    if is_csv(name):
        return "not_needed", csv_names(spark, uploaded)
    if needs_recognition(name):
        raise ConfigurationError("tables in documents have to be recognised first; see recognised_table")
    table = convert(spark, uploaded, table_index, iso_dates)
    table.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(location.source(f"{stem(name)}.csv"))
    return "converted", table.columns


def recognised_tables(blocks: DataFrame) -> DataFrame:
    """table_id, row_index, column_index, text of all cells of recognised tables.

    blocks: id, block_type, text, row_index, column_index, child_ids (array). TABLE blocks list CELL blocks, these WORD blocks;
    a cell's words are joined by spaces in their order."""
    kind = F.upper("block_type")
    tables = blocks.filter(kind == "TABLE").select(F.col("id").alias("table_id"), F.explode("child_ids").alias("cell"))
    cells = blocks.filter(kind == "CELL").select(F.col("id").alias("cell"), F.coalesce("row_index", F.lit(0)).alias("row_index"), F.coalesce("column_index", F.lit(0)).alias("column_index"), "child_ids")
    words = blocks.filter((kind == "WORD") & F.col("text").isNotNull()).select(F.col("id").alias("word"), F.col("text").alias("said"))
    held = tables.join(cells, "cell").select("table_id", "row_index", "column_index", F.posexplode_outer("child_ids").alias("k", "word")).join(words, "word", "left")
    said = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("k", "said"))))  # the words of one cell
    return held.groupBy("table_id", "row_index", "column_index").agg(F.concat_ws(" ", F.transform(said, lambda x: x["said"])).alias("text"))


def recognised_table(blocks: DataFrame, table_index: int = 0) -> DataFrame:
    """The table_index-th table (by id), its first row as the header, gaps as empty cells."""
    ids = [r["id"] for r in blocks.filter(F.upper("block_type") == "TABLE").select("id").orderBy("id").collect()]
    if table_index >= len(ids):
        raise ConfigurationError(f"the document has {len(ids)} table(s) but table_index is {table_index}")
    cells = recognised_tables(blocks).filter((F.col("table_id") == ids[table_index]) & (F.col("row_index") >= 1) & (F.col("column_index") >= 1))
    width = cells.agg(F.max("column_index")).first()[0] or 0
    grid = cells.groupBy("row_index").pivot("column_index", list(range(1, width + 1))).agg(F.first("text"))
    names = grid.filter("row_index = 1").first()
    last = cells.agg(F.max("row_index")).first()[0] or 0
    rows = cells.sparkSession.range(2, last + 1).select(F.col("id").cast("int").alias("row_index")).join(grid, "row_index", "left")
    return rows.orderBy("row_index").select(*[F.coalesce(quoted(str(k)), F.lit("")).alias((names[str(k)] if names else None) or f"column_{k}") for k in range(1, width + 1)])

