import io
import json
import zipfile

import pytest

from muster.context import ROW_ID, in_order, visible
from muster.errors import ConfigurationError, IngestionError, ValidationError
from muster.sources import convert, csv
from muster.sources.clients import Response, Retry
from muster.sources.sage import COLUMNS as SAGE_COLUMNS
from muster.sources.sage import SageConfig, sage
from muster.sources.workday import COLUMNS as WORKDAY_COLUMNS
from muster.sources.workday import ResponseGroup, WorkdayConfig, envelope, paging, workday


def rows(df):
    return [tuple(r) for r in in_order(df).collect()]


def test_csv_is_all_strings_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,email\n1,"Ann ""A"", B",\n2,"two\nlines",x\n3\n')
    got = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows(got) == [("1", 'Ann "A", B', None), ("2", "two\nlines", "x"), ("3", None, None)]
    assert {f.dataType.simpleString() for f in visible(got).schema} == {"string"} and ROW_ID in got.columns
    assert csv.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "c"]).columns[:3] == ["a", "b", "c"]
    with pytest.raises(ConfigurationError, match="2 names.*3 columns"):
        csv.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])


@pytest.mark.parametrize("part", [16, 61, 500, 1 << 20])
def test_csv_with_line_feeds_in_cells_read_by_many_tasks(spark, tmp_path, part):
    """Cut anywhere, also within cells and between the quotes of one: as one task reads the whole file."""
    import csv as plain
    import random

    rng = random.Random(part)
    cells = ["", "x", "a,b", 'say ""', "two\nlines", '"\n"', "\n\n", "é\r\nü", '""""', ",", " ", "l" * 40, '\n"', "0"]
    want = [tuple(rng.choice(cells) for _ in range(3)) for _ in range(150)]
    with open(tmp_path / "m.csv", "w", newline="") as f:
        plain.writer(f, lineterminator=rng.choice(["\n", "\r\n"]), quoting=plain.QUOTE_ALL if part == 61 else plain.QUOTE_MINIMAL).writerows([("p", "q", "r"), *want])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = csv.read_csv(spark, str(tmp_path / "m.csv"))
        assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > (3 if part < 1000 else 0)
        found = [tuple(r) for r in got.orderBy(ROW_ID).drop(ROW_ID).collect()]
        assert [tuple(x or "" for x in r) for r in found] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_csv_in_several_files_with_line_feeds(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"part-{k}.csv").write_text(f'a,"b\n"\n{k},"x\n{k}"\n\n{k}0,y\n')
    assert rows(csv.read_csv(spark, str(tmp_path / "d"), ["a", "b"]).orderBy(ROW_ID)) == [r for k in range(3) for r in ((str(k), f"x\n{k}"), (f"{k}0", "y"))]
    (tmp_path / "x.csv").write_text('a,b\n1,"2\n",3\n')
    with pytest.raises(Exception, match="more cells"):
        csv.read_csv(spark, str(tmp_path / "x.csv")).collect()


def test_csv_refuses_repeated_names_and_extra_cells(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ConfigurationError):
        csv.read_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "x.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        csv.read_csv(spark, str(tmp_path / "x.csv")).collect()


@pytest.mark.parametrize("bad", ["", "  ", "a/b.csv", "..\\x", "../x"])
def test_file_names(bad):
    with pytest.raises(ConfigurationError):
        csv.checked_filename(bad)


def test_locations(spark, tmp_path):
    assert [csv.stem(x) for x in ("a.b.xlsx", ".hidden", "plain")] == ["a.b", ".hidden", "plain"]
    where = csv.Location(str(tmp_path), "org", "co")
    assert where.source(" staff.xlsx ") == f"{tmp_path}/org/co/staff.csv"
    with pytest.raises(ConfigurationError):
        csv.generic_ingestion(spark, None, "a.csv")


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name":"Ann","age":30,"x":{"b":1,"a":[1]}},{"name":null,"other":1},{"age":1.5,"x":true}]')
    got = convert.convert(spark, str(tmp_path / "a.json"))
    assert got.columns == ["age", "name", "x"]
    assert rows(got) == [("30", "Ann", '{"a":[1],"b":1}'), ("", "", ""), ("1.5", "", "true")]
    (tmp_path / "o.json").write_text(json.dumps({"long": [{"a": 1}, {"a": 2}], "short": [{"b": 1}]}))
    assert convert.convert(spark, str(tmp_path / "o.json"), 1).columns == ["a"]
    with pytest.raises(Exception, match="fewer than 3"):
        convert.convert(spark, str(tmp_path / "o.json"), 2)


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<n:R xmlns:n="u"><Head>x</Head><n:E><Id> 1 </Id><Name>Ann</Name></n:E><n:E><Id>2</Id><Mail>m</Mail><Id>3</Id><Id>3</Id></n:E></n:R>')
    got = convert.convert(spark, str(tmp_path / "a.xml"))
    assert got.columns == ["Id", "Name", "Mail"]
    assert rows(got)[0] == ("1", "Ann", "") and rows(got)[1][1:] == ("", "m")


def test_json_by_the_reader_and_by_the_parser(spark, tmp_path):
    """Arrays of objects with values of all kinds: the reader's rows are the parser's."""
    import random

    rng = random.Random(1)
    values = [None, "", "x", "[1]", "null", 'q"u\\o', "é😀", 0, -7, 12345678901, 1.5, True, False, [], [1, "a"], {"b": 1, "a": [None]}, {}]
    objects = [{k: rng.choice(values) for k in rng.sample(["a", "b b", "c.d", "e"], rng.randint(1, 4))} for _ in range(60)]
    for k, root in enumerate((objects, {"n": 1, "z": objects[:3], "y": objects, "x": [], "w": objects[5:9] + [7]}, [{"a": 1}])):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(root, indent=k))
        for table in range(1 if isinstance(root, list) else 4):
            want = None if isinstance(root, dict) and not table else [*convert.json_rows(path.read_bytes(), table)]
            got = convert.json_table(spark, str(path), table)
            if want is None:
                assert got is None
                continue
            assert got.columns == want[0] and [list(r) for r in got.collect()] == want[1:]
            assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "odd.json").write_text('[{"a": 1}, 5]')
    assert convert.json_table(spark, str(tmp_path / "odd.json"), 0) is None and rows(convert.convert(spark, str(tmp_path / "odd.json"))) == [("1",), ("",)]
    for bad in ("", "[]", "{", "5"):
        (tmp_path / "bad.json").write_text(bad)
        assert convert.json_table(spark, str(tmp_path / "bad.json"), 0) is None


@pytest.mark.parametrize("part", [50, 1 << 20])
def test_xml_by_parts_and_as_a_whole(spark, tmp_path, part):
    import random

    rng = random.Random(part)
    record = lambda k: f'<p:R id="{k}">' + "".join(f"<p:{t} x='a'>{rng.choice([' v ', 'é&amp;', '<q>1</q><q>2</q>', ''])}</p:{t}>" for t in rng.sample(["A", "B", "C", "B"], 3)) + "</p:R>" if k % 7 else "<p:R></p:R>"
    text = '<?xml version="1.0"?>\n<p:root xmlns:p="u"><Head><A>no</A></Head>\n' + "\n".join(map(record, range(80))) + "<Foot/></p:root>"
    (tmp_path / "a.xml").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, (part, 0)):
        spark.conf.set(k, v)
    try:
        got = convert.xml_table(spark, str(tmp_path / "a.xml"))
        want = [*convert.xml_rows(text.encode(), 0)]
        assert got.columns == want[0] and sorted(map(list, got.collect())) == sorted(want[1:])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for odd in (text.replace("<Foot/>", "<!-- > -->"), text.replace("<Foot/>", "<p:R><p:R><A>1</A></p:R></p:R>"), text.replace("<Foot/>", "<R><A>1</A></R>"), text.replace("<Foot/>", '<Foot a="x>y"/>'), "<a/>"):
        (tmp_path / "odd.xml").write_text(odd)
        assert convert.xml_table(spark, str(tmp_path / "odd.xml")) is None


def test_xml_in_parts(spark, tmp_path):
    """An upload in parts whose files have their own blocks, and one with a record in two of its parts."""
    text = '<p:Rs xmlns:p="u"><Head>x</Head>\n' + "\n".join(f"<p:R><p:{'AB'[k > 9]}>{k}</p:{'AB'[k > 9]}><p:C>c</p:C></p:R>" for k in range(30)) + "</p:Rs>"
    lines, want = text.splitlines(keepends=True), [*convert.xml_rows(text.encode(), 0)]
    for name, cuts in (("parts", (len(lines[0]), len("".join(lines[:20])))), ("cut", (len("".join(lines[:3])) + 20,))):
        (tmp_path / f"{name}.xml").mkdir()
        for k, (lo, hi) in enumerate(zip((0, *cuts), (*cuts, None))):
            (tmp_path / f"{name}.xml" / f"part-{k}").write_text(text[lo:hi])
        got = convert.convert(spark, str(tmp_path / f"{name}.xml"))
        assert got.columns == want[0] and sorted(map(list, got.collect())) == sorted(want[1:])
    assert convert.xml_table(spark, str(tmp_path / "parts.xml")) is not None and convert.xml_table(spark, str(tmp_path / "cut.xml")) is None


def workbook(cells):
    sheet = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in cells)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    data = workbook([(1, ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="inlineStr"><is><t>ok</t></is></c>']), (2, ['<c r="A2"><v>7.0</v></c>', '<c r="C2" t="b"><v>1</v></c>']), (3, ['<c r="A3"><v>1.25</v></c>', '<c r="B3" t="e"><v>#N/A</v></c>'])])
    (tmp_path / "a.XLSX").write_bytes(data)
    got = convert.convert(spark, str(tmp_path / "a.XLSX"))
    assert got.columns == ["id", "name", "ok"] and rows(got) == [("7", "", "true"), ("1.25", "#ERR:#N/A", "")]
    with pytest.raises(Exception, match="table_index is 1"):
        convert.convert(spark, str(tmp_path / "a.XLSX"), 1)
    where = csv.Location(str(tmp_path), "o", "c")
    assert convert.prepare_source(spark, where, str(tmp_path / "a.XLSX")) == ("converted", ["id", "name", "ok"])
    assert rows(csv.generic_ingestion(spark, where, "a.XLSX").data)[0][0] == "7"


def test_a_sheet_in_ranges(spark, tmp_path, monkeypatch):
    """Several tasks each take stretches of rows: as one task takes all, with gaps, rows without numbers and odd attributes."""
    def cell(r, c):
        return f'<c r="{"ABC"[c]}{r}"><v>{r}{c}</v></c>' if (r + c) % 3 else f'<c r="{"ABC"[c]}{r}" t="inlineStr" x14:q="1"><is><t>t&lt;{r}</t></is></c>'

    numbers = [r for r in range(1, 20_000) if r % 7 or r < 8]
    cells = [(r, ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="inlineStr"><is><t>k</t></is></c>'] if r == 1 else [cell(r, c) for c in range(3) if (r + c) % 5]) for r in numbers]
    (tmp_path / "big.xlsx").write_bytes(workbook(cells))
    monkeypatch.setattr(convert, "PIECE", 777)
    whole, parts = (convert.xlsx_table(spark, str(tmp_path / "big.xlsx"), part_bytes=n) for n in (1 << 30, 60_000))
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() > 3
    got = [tuple(r) for r in whole.collect()]
    assert len(got) == 19_997 and sorted(got) == sorted(tuple(r) for r in parts.collect())
    assert got[12] == ("", "", "") and got[0] == ("20", "t<2", "22") and got[2] == ("40", "", "t<4")


def test_workbooks_with_one_header(spark, tmp_path):
    """Several workbooks are one table, wherever their headers are; other headers are refused."""
    head, row = ['<c t="s"><v>0</v></c>', '<c t="s"><v>1</v></c>'], lambda k: [f"<c><v>{k}</v></c>"]
    for name, cells in (("a", [(1, head), (2, row(1))]), ("b", [(3, head), (4, row(2)), (5, row(3))]), ("c", [(1, head)]), ("d", [(1, head[:1])])):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook(cells))
    got = convert.xlsx_table(spark, [str(tmp_path / f"{n}.xlsx") for n in "abc"])
    assert got.columns == ["id", "name"] and sorted(rows(got)) == [("1", ""), ("2", ""), ("3", "")]
    with pytest.raises(ConfigurationError, match="different headers"):
        convert.xlsx_table(spark, [str(tmp_path / f"{n}.xlsx") for n in "ad"])


def test_shared_strings_and_sheets_are_not_held_as_trees(tmp_path):
    """A sheet of some 12 MB is taken apart in a fraction of that memory."""
    import tracemalloc

    row = "".join(f'<c r="{c}{{0}}" t="s"><v>1</v></c>' for c in "ABCDEFGH")
    data = workbook([(r, [row.format(r)]) for r in range(1, 40_000)])
    tracemalloc.start()
    n = sum(len(cells) for _, cells in convert.sheet_rows(data, 0, part=3, parts=4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8 * sum((r - 1) // convert.ROWS % 4 == 3 for r in range(1, 40_000)) and peak < 8e6


def test_dates_of_workbooks():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    styles = f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0.0"/><numFmt numFmtId="166" formatCode="[Red]0"/></numFmts>'
    styles += '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf/></cellXfs></styleSheet>'
    assert convert.date_styles(styles.encode()) == {1, 2}
    assert [convert.iso_date(x, False) for x in (1, 59, 61, 45292, 45292.75)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-01", "2024-01-01 18:00:00"]
    assert convert.iso_date(0, True) == "1904-01-01"


def test_kinds(spark, tmp_path):
    for name in ("a.xls", "a.txt"):
        with pytest.raises(ConfigurationError):
            convert.convert(spark, name)
    assert convert.needs_recognition("x.PDF") and convert.is_csv("x.CSV") and convert.extension("x") == ""
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValidationError):
        convert.csv_names(spark, str(tmp_path / "e.csv"))
    (tmp_path / "h.csv").write_text(' "a" ,b,,c\n1,2,3,4\n')
    assert convert.csv_names(spark, str(tmp_path / "h.csv")) == ["a", "b", "c"]


def test_recognised_table(spark):
    schema = "id string, block_type string, text string, row_index int, column_index int, child_ids array<string>"
    blocks = [("t", "TABLE", None, None, None, ["c1", "c2", "c3", "gone"]), ("c1", "CELL", None, 1, 1, ["w1", "w2"]), ("c2", "CELL", None, 1, 2, ["w3"]), ("c3", "cell", None, 3, 2, ["w4"]), ("w1", "WORD", "First", None, None, []), ("w2", "WORD", "Name", None, None, None), ("w3", "WORD", "Age", None, None, []), ("w4", "WORD", "42", None, None, [])]
    got = convert.recognised_table(spark.createDataFrame(blocks, schema))
    assert got.columns == ["First Name", "Age"] and rows(got) == [("", ""), ("", "42")]
    with pytest.raises(ConfigurationError):
        convert.recognised_table(spark.createDataFrame(blocks, schema), 1)


WORKER = "<wd:Worker><wd:Worker_ID></wd:Worker_ID><wd:WID>w{0}</wd:WID><wd:First_Name> Ann<x/>z</wd:First_Name><bsvc:Hire_Date>2024</bsvc:Hire_Date><wd:Status a='1'>no</wd:Status></wd:Worker>"


class Soap:
    def __init__(self, pages):
        self.pages = pages

    def post(self, url, body):
        import re

        page = int(re.search("Page>(\\d+)<", body)[1])
        workers = "".join(WORKER.format(f"{page}{k}") for k in range(2))
        return Response(200, f"<x><wd:Total_Pages>{self.pages}</wd:Total_Pages>{workers}</x>")


def test_workday(spark, monkeypatch):
    config = WorkdayConfig("https://t/", "acme", "u<", "env:PW")
    with pytest.raises(ConfigurationError):
        config.secret()
    monkeypatch.setenv("PW", "p&q")
    assert config.endpoint == "https://t/ccx/service/acme/Human_Resources/v45.2"
    text = envelope(config, 3)
    assert "u&lt;@acme" in text and "p&amp;q" in text and "<bsvc:Page>3<" in text and "<bsvc:Include_Roles>false<" in text and "<bsvc:Include_Personal_Information>true<" in text
    assert ResponseGroup().include_employment_information and paging("") == {"Total_Results": 0, "Total_Pages": 1, "Page_Results": 0, "Page": 1}
    got = workday(spark, config, Soap(3))
    assert got.columns == list(WORKDAY_COLUMNS) and len(got.columns) == 18 and got.metadata["email"].source == "WORKDAY_HRIS"
    r = got.data.filter("worker_id = 'w30'").first()
    assert (r.first_name, r.hire_date, r.worker_status, r.email) == ("Ann", "2024", "", "") and got.data.count() == 6

    class Broken:
        def post(self, url, body):
            return Response(500, "<faultstring>no luck</faultstring>")

    with pytest.raises(IngestionError, match="no luck"):
        workday(spark, config, Broken())


class Rest:
    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def get(self, url, headers, query):
        self.asked.append(query)
        return self.pages[int(query["page"]) - 1]


def test_sage(spark):
    config = SageConfig(" .acme. ", "tok", include_team_history=True)
    assert config.endpoint == "https://acme.sage.hr/api/employees"
    first = {"data": [{"id": 1, "first_name": "Ann", "post_code": 1234, "team_id": 7, "team_history": [{"team_id": 1}]}], "meta": {"current_page": 1, "next_page": 2}}
    second = {"data": [{"id": 2, "email": None, "post_code": "AB1"}, {"id": 3, "post_code": {"x": 1}}], "meta": {"current_page": 2, "next_page": 1}}
    client = Rest([Response(200, json.dumps(first)), Response(200, json.dumps(second))])
    got = sage(spark, config, client)
    assert got.columns == list(SAGE_COLUMNS) and len(got.columns) == 23
    assert [(r.id, r.first_name, r.post_code, r.team_id, r.email) for r in got.data.orderBy("id").collect()] == [("1", "Ann", "1234", "7", ""), ("2", "", "AB1", "", ""), ("3", "", "", "", "")]
    assert client.asked == [{"page": "1", "team_history": "true"}, {"page": "2", "team_history": "true"}]
    empty = Rest([Response(200, '{"data":[],"meta":{"next_page":null}}')])
    assert sage(spark, config, empty).data.count() == 0
    for bad in (Response(401, "no"), Response(200, "{")):
        with pytest.raises(IngestionError):
            sage(spark, config, Rest([bad]))


class Counted:
    """A client of this module, which workers cannot import."""

    def get(self, url, headers, query):
        page = int(query["page"])
        return Response(200, json.dumps({"data": [{"id": 10 * page + k} for k in range(2)], "meta": {"next_page": page + 1 if page < 4 else None, "total_pages": 4}}))


def test_pages_that_are_counted_are_fetched_by_tasks(spark):
    got = sage(spark, SageConfig("acme", "tok"), Counted()).data
    assert sorted(r.id for r in got.collect()) == sorted(str(10 * p + k) for p in range(1, 5) for k in range(2))


def test_retry():
    pauses, answers = [], iter([Response(500, ""), Response(429, ""), Response(200, "ok")])
    assert Retry(sleep=pauses.append).run(lambda: next(answers)).body == "ok" and pauses == [0.5, 1.0]
    assert Retry(attempts=2, sleep=pauses.append).run(lambda: Response(503, "")).status == 503

    def fails():
        raise OSError("down")

    with pytest.raises(OSError):
        Retry(sleep=pauses.append).run(fails)


@pytest.mark.parametrize("part", [150, 1 << 20])
def test_json_by_parts(spark, tmp_path, part):
    """Blocks that end in texts, marks and nested values, and an upload in parts: as the parser has it, by tasks that hold no array."""
    objects = [{"a": k, "b": {"x": [{"y": "}],{["}, k], "z": 'q"\\'}, "c": ["}", "\\\"}", None][k % 3]} for k in range(16)]
    root = {"n": 1, "o": {"p": {"q": [1]}, "r": 2}, "few": [{"a": 1}], "none": [], "rows": objects[:9] + [7, None] + objects[9:], "s": "}]"}
    texts = {"array": json.dumps(objects, separators=(",", ":")), "object": json.dumps(root, indent=1)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, (part, 0)):
        spark.conf.set(k, v)
    try:
        for name, text in texts.items():
            (tmp_path / f"{name}.json").write_text(text)
            (tmp_path / f"{name}-parts.json").mkdir()
            for k in range(5):
                (tmp_path / f"{name}-parts.json" / f"part-{k}").write_text(text[k * len(text) // 5 : (k + 1) * len(text) // 5])
            want = [*convert.json_rows(text.encode(), 2)]
            for path in (f"{name}.json", f"{name}-parts.json"):
                got = convert.json_table(spark, str(tmp_path / path), 2)
                assert got.columns == want[0] and sorted(map(list, got.collect())) == sorted(want[1:])
        for k, odd in enumerate(() if part < 1000 else ('[{"a":1}{"a":2}]', '[{"a":1},]', '[{"a":1}]]', '[{"a":1}}', '{"a":[{"b":1}],"a":[{"b":2}]}', '{"a":[{"b":1}] "c":1}', '{"a":[{"b":1}],"c":x}', '[{"a":1},{"a":"}]', '[{"a":1,"a":2}]', '{"a":[{"b":1}}]')):
            (tmp_path / f"odd{k}.json").write_text(odd)
            assert convert.json_table(spark, str(tmp_path / f"odd{k}.json"), 0) is None
        (tmp_path / "odd-parts.json").mkdir()
        for k, text in enumerate(('[{"a":', "1},5]")):
            (tmp_path / "odd-parts.json" / f"part-{k}").write_text(text)
        assert rows(convert.convert(spark, str(tmp_path / "odd-parts.json"))) == [("1",), ("",)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
