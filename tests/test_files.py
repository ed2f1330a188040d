import io
import random
import re
import zipfile
from email.message import EmailMessage

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import office, profile
from foliant.sources import delimited, files

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def zipped(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x_", "."), text)
    return raw.getvalue()


def rels(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets)) + "</Relationships>"


def xlsx():
    return zipped(**{
        "xl__workbook_x_xml": f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets><sheet name="One" r:id="r0"/><sheet name="Two" state="hidden" r:id="r1"/></sheets></workbook>',
        "xl___rels__workbook_x_xml_x_rels": rels("worksheets/a.xml", "worksheets/b.xml"),
        "xl__sharedStrings_x_xml": f'<sst xmlns="{M}"><si><t>shared</t></si></sst>',
        "xl__worksheets__a_x_xml": f'<worksheet xmlns="{M}"><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>inline</t></is></c></row><row><c t="b"><v>1</v></c><c><f>SUM(A1)</f><v>3</v></c></row></sheetData></worksheet>',
        "xl__worksheets__b_x_xml": f'<worksheet xmlns="{M}"><sheetData/></worksheet>',
    })


def pptx():
    sp = lambda t, kind="": f'<sp><nvPr>{f"<ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</nvPr><p><r><t>{t}</t></r></p></sp>'
    return zipped(**{
        "ppt__presentation_x_xml": f'<p xmlns:r="{R}"><sldIdLst><sldId r:id="r1"/><sldId r:id="r0"/></sldIdLst></p>',
        "ppt___rels__presentation_x_xml_x_rels": rels("slides/a.xml", "slides/b.xml"),
        "ppt__slides__a_x_xml": f'<sld show="0">{sp("Last", "title")}</sld>',
        "ppt__slides__b_x_xml": f'<sld>{sp("Body")}{sp("First", "title")}</sld>',
        "ppt__slides___rels__b_x_xml_x_rels": rels("../notesSlides/n.xml"),
        "ppt__notesSlides__n_x_xml": f'<n>{sp("said")}{sp("img", "sldImg")}</n>',
    })


def docx():
    return zipped(**{"word__document_x_xml": '<d xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:t>a</w:t><w:t>b</w:t></w:p></d>'})


def epub(**more):
    return zipped(**{
        "META-INF__container_x_xml": '<c><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>',
        "O__p_x_opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="gone"/></spine></package>',
        "O__a_x_xhtml": "<p>A</p>", "O__b_x_xhtml": "<p>B</p>",
    } | more)


def eml():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "Hi", "a@x.org", "b@x.org, c@x.org", "Tue, 02 Jan 2024 03:04:05 +0000"
    m.set_content("plain")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"12345", maintype="application", subtype="octet-stream", filename="f.bin")
    return bytes(m)


def rows(spark, kind, raw):
    return files.contents(spark.createDataFrame([("f", bytearray(raw))], "path string, content binary"), kind).collect()


def test_xlsx(spark):
    got = rows(spark, "xlsx", xlsx())
    assert [(r.sheet, r.visibility, r.row_index, r.cells, r.formulas) for r in got] == [("One", "visible", 0, ["shared", "inline"], [None, None]), ("One", "visible", 1, ["TRUE", "3"], [None, "SUM(A1)"]), ("Two", "hidden", None, [], [])]


def test_pptx(spark):
    assert [(r.slide, r.hidden, r.title, r.text, r.notes) for r in rows(spark, "pptx", pptx())] == [(1, False, "First", "Body\nFirst", "said"), (2, True, "Last", "Last", None)]


def test_docx(spark):
    assert [(r.style, r.text) for r in rows(spark, "docx", docx())] == [("Heading1", "Head"), (None, "ab")]


def test_epub(spark):
    assert [(r.chapter, r.markup) for r in rows(spark, "epub", epub())] == [(1, "<p>B</p>"), (2, "<p>A</p>")]
    assert "encrypted" in rows(spark, "epub", epub(**{"META-INF__encryption_x_xml": "x"}))[0].problem.detail
    assert "document type" in rows(spark, "epub", epub(**{"META-INF__container_x_xml": "<!DOCTYPE x><c/>"}))[0].problem.detail


def test_eml(spark):
    r = rows(spark, "eml", eml())[0]
    assert (r.subject, r.sender, r.recipients, r.sent, r.body.strip(), r.markup.strip()) == ("Hi", "a@x.org", ["b@x.org", "c@x.org"], "2024-01-02T03:04:05+00:00", "plain", "<p>html</p>")
    assert [tuple(a) for a in r.attachments] == [("f.bin", "application/octet-stream", 5)]


def test_zip_and_broken_files(spark):
    raw = zipped(a="x" * 100, d__="")
    assert [(r.entry, r.is_dir, r.method) for r in rows(spark, "zip", raw)] == [("a", False, "deflated"), ("d/", True, "stored")]
    for kind in ("zip", "xlsx", "pptx", "docx", "epub"):
        assert rows(spark, kind, raw[:20])[0].problem


@pytest.mark.parametrize(
    ("raw", "want", "delimiter"),
    [
        (b"Title,Author,Year\na,b,1\n", [["Title", "Author", "Year"], ["a", "b", "1"]], ","),
        (b"a;b;c\n1;2;3\n", [["a", "b", "c"], ["1", "2", "3"]], ";"),
        (b'a,b\n"one, two","line1\nline2"\n', [["a", "b"], ["one, two", "line1\nline2"]], ","),
        (b'ab"c,d"e,f\n', [["abc,de", "f"]], ","),
        (b'\xef\xbb\xbfa,"x""y"\r\n\r\n1,2', [["a", 'x"y'], ["1", "2"]], ","),
        (b"", [], ","),
    ],
)
def test_delimited(raw, want, delimiter):
    if not want:
        with pytest.raises(files.Refused):
            list(files.delimited(raw))
        return
    got = list(files.delimited(raw))
    assert [r[2] for r in got] == want
    assert {r[1] for r in got} <= {delimiter}


@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\r\x00")), min_size=2, max_size=4), min_size=1, max_size=5))
def test_split_round_trip(table):
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in row) for row in table)
    assert list(files.split_rows(text, ",")) == [[c for c in row] for row in table]


def test_profile_types(spark):
    lines = [("age", "12"), ("age", "-3"), ("joined", "2024-01-02"), ("active", "true"), ("active", "no"), ("score", "1.5"), ("score", "1,234"), ("city", "Rome"), ("city", " ")]
    df = spark.createDataFrame([(0, *x) for x in lines], "position int, name string, value string")
    got = {r.name: (r.inferred_type, r.min_value, r.max_value, r.empty) for r in profile.profile(df).collect()}
    assert got == {"age": ("integer", "-3", "12", 0), "joined": ("date", "2024-01-02T00:00:00", "2024-01-02T00:00:00", 0), "active": ("boolean", None, None, 0), "score": ("decimal", "1.5", "1234.0", 0), "city": ("string", "4", "4", 1)}


def test_scan_and_reassemble(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"hello")
    r = files.scan(spark, str(tmp_path), most_bytes=10).first()
    assert (r.file_name, r.ext, r.length) == ("a.TXT", "txt", 5)
    assert files.scan(spark, str(tmp_path), most_bytes=4).first().problem.status == 413
    chunks = spark.createDataFrame([("f", 2, bytearray(b"lo")), ("f", 1, bytearray(b"hel"))], "file_name string, seq int, data binary")
    assert bytes(files.reassemble(chunks).first().content) == b"hello"


def test_office_aggregates(spark):
    from foliant.operators import office

    def held(kind, raw):
        return files.contents(spark.createDataFrame([("f", bytearray(raw)), ("bad", bytearray(b"PK"))], "path string, content binary"), kind)

    assert [(r.sheet, r.row_count, r.cell_count, r.formula_count, r.column_count) for r in office.sheets(held("xlsx", xlsx())).collect()] == [("One", 2, 4, 1, 2), ("Two", 0, 0, 0, 0)]
    assert {(r.path, r.errors, r.healthy) for r in office.workbook_health(held("xlsx", xlsx()), held("xlsx facts", xlsx())).collect()} == {("f", 0, True), ("bad", 1, False)}
    assert office.outline(held("pptx", pptx())).first().markdown == "## 1. First\n\n- Body\n\n> **Notes:** said\n\n## 2. Last"
    book = office.book_text(held("epub", epub())).first()
    assert (book.chapters, book.text, book.words) == (2, "B\n\nA", 2)


def test_risky_names_are_parts_of_formulas(spark):
    from pyspark.sql import functions as F

    from foliant.operators import office

    df = spark.createDataFrame([("RECALL(1)",), ("ddeauto",), ("SUM(A1)",), (None,)], "f string")
    assert [r.x for r in df.select(office.risky(F.col("f")).alias("x")).collect()] == ["CALL", "DDE", None, None]


def test_no_row_is_cut():
    sheet = f'<worksheet xmlns="{M}"><sheetData>{"<row><c><v>1</v></c></row>" * 100_003}</sheetData></worksheet>'
    raw = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx())) as old, zipfile.ZipFile(raw, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name == "xl/worksheets/a.xml" else old.read(name))
    assert sum(r[3] is not None for r in files.sheet_rows(raw.getvalue())) == 100_003
    assert sum(1 for _ in files.delimited(b"a,b\n" * 1_000_003)) == 1_000_003


def test_workbook_without_sheets_is_a_problem(spark):
    assert "no sheets" in rows(spark, "xlsx", zipped(**{"xl__workbook_x_xml": f'<workbook xmlns="{M}"><sheets/></workbook>'}))[0].problem.detail


def test_large_files_are_problems(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x" * 1000)
    got = {r.file_name: r for r in files.scan(spark, str(tmp_path), most_bytes=100).collect()}
    assert bytes(got["a.txt"].content) == b"x" * 10 and got["a.txt"].problem is None
    assert got["b.txt"].content is None and got["b.txt"].problem.status == 413
    assert files.scan(spark, str(tmp_path), most_bytes=0).where("problem IS NOT NULL").count() == 0


@pytest.mark.parametrize(("text", "issues", "more"), [
    ("a,b,c\n1,2,3\n4,5\n6,7,8\n", ["ragged_rows:error"], {"ragged_rows": 1, "first_ragged": 3}),
    ("id,name,name\n1,a,b\n", ["header:warning"], {"has_header": True}),
    ("1,2,3\n4,5,6\n", ["header:info"], {"has_header": False, "headers": ["column1", "column2", "column3"], "data_row_count": 2}),
    ("a,b\r\n1,2\n3,4\r\n", ["line_endings:warning"], {"line_ending": "mixed"}),
    ("", ["empty:error"], {"row_count": 0}),
    ("\ufeffa,b\n1,2\n", [], {"has_bom": True, "headers": ["a", "b"]}),
])
def test_inspection_of_delimited_files(spark, text, issues, more):
    made = spark.createDataFrame([("x", bytearray(text.encode()))], "path string, content binary")
    got = profile.inspection(made, files.contents(made, "csv")).collect()[0]
    assert [f"{i.check}:{i.severity}" for i in got.issues] == issues
    assert {k: got[k] for k in more} == more


def test_profiles_of_files(spark):
    texts = {"a": "city,country,when\nRome,IT,2024-01-02\nParis,,2/3/2024\nBonn,DE,4 Mar 2024 10:30\nRome,IT,2024-01-02\n", "b": "n\n5\n-3\n12,1\n"}
    made = spark.createDataFrame([(k, bytearray(t.encode())) for k, t in texts.items()], "path string, content binary")
    got = {(r.path, r.position): r for r in profile.profile_files(files.contents(made, "csv"), samples=2).collect()}
    assert [got["a", k].name for k in range(3)] == ["city", "country", "when"] and got["a", 0].samples == ["Rome", "Paris"]
    assert (got["a", 1].non_empty, got["a", 1].empty, got["a", 1].distinct_count) == (3, 1, 2)
    assert (got["a", 2].inferred_type, got["a", 2].min_value, got["a", 2].max_value) == ("date", "2024-01-02T00:00:00", "2024-03-04T10:30:00")
    # the widest row has two cells, so that the first one names nothing; it is a header all the same
    assert [got["b", k].name for k in range(2)] == ["column1", "column2"] and (got["b", 0].inferred_type, got["b", 0].non_empty) == ("integer", 3)


def test_samples_and_distinct_values_of_long_files(spark):
    lines = [(0, ["id", "late", "few"])] + [(n, [f"k{n}", "found" if n > 1500 else " ", f"v{n % 9_999}"]) for n in range(1, 20_002)]
    df = spark.createDataFrame([("x", line, ",", cells, None) for line, cells in lines], "path string, line int, delimiter string, cells array<string>, problem string").repartition(5)
    got = {r.name: r for r in profile.profile_files(df, samples=3).collect()}
    assert [got[c].distinct_count for c in ("id", "late", "few")] == [10_000, 1, 9_999]
    assert got["late"].samples == ["found"] * 3 and got["id"].samples == ["k1", "k2", "k3"] and got["few"].non_empty == 20_001
    # what is shuffled follows columns, not values
    plan = profile.profile(df.selectExpr("line % 2 AS position", "path AS name", "cells[0] AS value"))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("value" in x for x in dealt)


RANGED = ['"', "a,", "b;", "\n", "\r\n", 'x"y', '""', ",", "é", "\r", "word ", '"q\n"']


@pytest.mark.parametrize("size", [7, 64, None])
def test_delimited_files_by_ranges(spark, tmp_path, size):
    draw = random.Random(3)
    raws = {f"{i}.csv": "".join(draw.choice(RANGED) for _ in range(draw.randrange(1, 120))).encode() for i in range(12)}
    raws |= {"bom": b'\xef\xbb\xbfid;"a\n\nb"\n1;2', "bom2": b'\xef\xbb\xbfid,"a\n', "bom3": b'\xef\xbb\xbfid,"a', "bad": b'id,\xff\n"1,2\n\n\n', "blank": b'\n\r\n""\n', "crlf": b"a,b\r\n1,2\r\n", "cr": b"a,b\n1,2\r"}
    for name, raw in raws.items():
        (tmp_path / name).write_bytes(raw)
    got = delimited.read_delimited(spark, str(tmp_path), range_bytes=size)
    found = {}
    for r in got.rows.collect():
        found.setdefault(r.path.rpartition("/")[2], []).append((r.line, r.delimiter, r.cells, r.problem and r.problem.status))
    for name, raw in raws.items():
        try:
            want = [(*x, None) for x in files.delimited(raw)]
        except files.Refused:
            want = [(None, None, None, 422)]
        assert sorted(found[name], key=lambda x: x[0] or 0) == want
    about = {r.path.rpartition("/")[2]: (r.length, r.line_ending, r.has_bom) for r in got.files.collect()}
    assert about["bom"] == (16, "lf", True) and about["crlf"] == (10, "crlf", False) and about["cr"] == (8, "mixed", False) and about["blank"][1] == "mixed"


def test_delimited_files_by_ranges_when_states_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_RANGES", 1)
    text = "\n".join(f'{n},"{"x" * (n % 50)}\n{n}"' for n in range(2000))
    (tmp_path / "f").write_text(text)
    rows = delimited.read_delimited(spark, str(tmp_path), range_bytes=5000).rows.orderBy("line").collect()
    assert [r.line for r in rows] == list(range(2000)) and [r.cells for r in rows] == list(files.split_rows(text, ","))


def test_inspection_of_files_by_ranges(spark, tmp_path):
    (tmp_path / "f").write_bytes(b'id,note\n1,"a\nb"\n2\n')
    got = delimited.read_delimited(spark, str(tmp_path), range_bytes=4)
    r = profile.inspection(got.files, got.rows).collect()[0]
    assert (r.row_count, r.column_count, r.ragged_rows, r.first_ragged, r.line_ending, [i.check for i in r.issues]) == (3, 2, 1, 3, "lf", ["ragged_rows"])


def test_rows_of_delimited_files(spark):
    made = spark.createDataFrame([("x", bytearray(b"a\n1\n2\n3\n")), ("none", bytearray())], "path string, content binary")
    lines = files.contents(made, "csv")
    assert [r.cells for r in profile.data_rows(lines, 2).where("path = 'x'").orderBy("row").collect()] == [["1"], ["2"]]
    assert profile.data_rows(lines, 0).where("path = 'x'").count() == 3
    assert profile.data_rows(lines).where("path = 'none'").collect()[0].problem.status == 422


def test_books_that_are_not_valid(spark):
    facts = lambda raw: {(r.kind, r.name) for r in rows(spark, "epub facts", raw)}
    assert ("error", "container") in facts(b"nothing") and ("error", "mimetype") in facts(epub())
    bad = facts(epub(mimetype="text/plain", **{"META-INF__encryption_x_xml": "x"}))
    assert {("error", "mimetype"), ("error", "drm"), ("error", "spine"), ("warning", "metadata")} <= bad
    assert ("error", "limits") in facts(zipped(mimetype="application/epub+zip", big="0" * 3_000_000))


def test_search_over_joined_rows(spark):
    """A match over two paragraphs and one over four, offsets in the file, every size of reach."""
    draw = random.Random(6)
    rows = [(f, n, "".join(draw.choice("ab \n") for _ in range(draw.randrange(0, 30))) if draw.random() < 0.9 else None) for f in ("x", "y") for n in range(150)]
    rows += [("z", 0, "one two"), ("z", 1, "three"), ("z", 2, ""), ("z", 3, None), ("z", 4, "End"), ("w", 0, "")]
    df = spark.createDataFrame(rows, "path string, place int, text string").repartition(3)
    for pattern, reach in (("a+b\n?a", 40), ("(?<=b)a[ab \n]{3}", 12), ("b a", 3), ("aa", 2)):
        got = sorted(tuple(r) for r in office.search_joined(df, pattern=pattern, context=5, reach=reach).collect())
        want = []
        for f in ("x", "y", "z", "w"):
            mine = [(n, t or "") for k, n, t in sorted(rows, key=lambda r: r[:2]) if k == f]
            whole = "\n".join(t for _, t in mine)
            for m in re.finditer(pattern, whole):
                if len(m[0]) <= reach:
                    place = mine[0][0] + whole.count("\n", 0, m.start()) if f == "z" else None
                    want.append((f, place, m[0], m.start(), m.end(), whole[max(0, m.start() - 5) : m.end() + 5]))
        assert sorted((g[0], *g[2:]) for g in got) == sorted((w[0], *w[2:]) for w in want)
    hit = office.search_joined(df.where("path = 'z'"), query="THREE\n\n\nend", context=2, reach=20).collect()
    assert [tuple(h) for h in hit] == [("z", 1, "three\n\n\nEnd", 8, 19, "o\nthree\n\n\nEnd")]
    assert office.search_joined(df.where("false"), query="a").count() == 0
    with pytest.raises(ValueError):
        office.search_joined(df, query="a", pattern="b")


def test_details_of_office_files(spark):
    p = lambda t: f"<p><r><t>{t}</t></r></p>"
    core = "<p><created>2024-01-02T03:04:05Z</created><modified>2024-02-02</modified></p>"
    doc = zipped(word__document_x_xml=f"<document><body>{p('the cat and the dog')}{p('')}<tbl><tr><tc>{p('of the house')}<tbl><tr><tc>{p('in')}</tc></tr></tbl></tc></tr></tbl></body></document>", word__media__a_x_png="x", docProps__core_x_xml=core)
    made = spark.createDataFrame([("d", bytearray(doc)), ("bad", bytearray(b"x"))], "path string, content binary")
    got = office.document_details(files.contents(made, "docx"), files.contents(made, "docx facts")).collect()
    assert [(r.path, r.all_paragraphs, r.tables, r.images, r.language, r.created, r.modified) for r in got] == [("d", 4, 2, 1, "en", "2024-01-02T03:04:05Z", "2024-02-02")]
    slide = f"<sld><sp>{p('der Hund und die Katze')}</sp><sp>{p('im Haus und das')}</sp><pic/><pic/><graphic><tbl/></graphic></sld>"
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    deck = zipped(ppt__presentation_x_xml=f'<p {rel}><sldIdLst><sldId r:id="r1"/></sldIdLst></p>', ppt___rels__presentation_x_xml_x_rels='<R><Relationship Id="r1" Target="slides/1.xml"/></R>', ppt__slides__1_x_xml=slide)
    made = spark.createDataFrame([("p", bytearray(deck))], "path string, content binary")
    r = office.slide_details(files.contents(made, "pptx"), files.contents(made, "properties")).collect()[0]
    assert (r.shapes, r.pictures, r.tables, r.language, r.created, r.modified) == (2, 2, 1, "de", None, None)
    rows_ = spark.createDataFrame([("w", ["the cat", "and the"], None), ("w", ["dog of the house"], None), ("e", None, None)], "path string, cells array<string>, problem string")
    facts = spark.createDataFrame([("w", "property", "created", "2020", None)], "path string, kind string, name string, value string, problem string")
    got = {r.path: (r.language, r.created, r.modified) for r in office.workbook_details(rows_, facts).collect()}
    assert got == {"w": ("en", "2020", None), "e": (None, None, None)}


def test_files_are_made_by_several_tasks_a_few_at_once(spark, tmp_path):
    """Files of small rows are dealt to as many tasks as the rows ask for, and a task makes few of them at a time."""
    from foliant.plans import files as plans

    rows = spark.range(2 * plans.TASK_ROWS + 1).selectExpr("id", "id % 500 AS conv_id", "CAST(id AS int) AS turn")
    dealt = plans.by_file(rows, F.col("conv_id").cast("string"))
    made = dealt.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in made}) == 3 and sum(r.n for r in made) == 2 * plans.TASK_ROWS + 1 and len(made) == 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(100))], ["x"])
    parts = list(plans.some_at_once([batch]))
    assert max(map(len, parts)) <= plans.AT_ONCE and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(100))
