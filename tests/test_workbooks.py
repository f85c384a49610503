"""Workbooks: what is written is read back; files of other writers; streaming; queries in test_outside_sql."""

import datetime
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.sources import workbooks

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _foreign(path, sheet, shared="", styles="", props=""):
    """A workbook as other programs write it: prefixes, absolute targets, rich text, custom formats."""
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<x:workbook xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{r}">{props}<x:sheets><x:sheet name="A &amp; B" sheetId="7" r:id="r9"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Type="t" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {M}><cols><col/></cols><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {M}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {M}>{styles}</styleSheet>")
    return str(path)


def test_cells_of_other_writers(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    shared = "<si><t>name</t></si><si><r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh><t>no</t></rPh></si><si/>"
    sheet = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>when</t></is></c><c r="D2" t="str"><v>v</v></c><c r="AA2" t="str"><v>v</v></c></row>'
        '<row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" s="1"><v>43831.5</v></c><c r="D5" s="2"><f>1+1</f><v>2</v></c><c r="AA5" t="b"><v>1</v></c></row>'
        '<row><c t="s"><v>2</v></c><c t="d"><v>2020-02-03T00:00:00Z</v></c><c t="e"><v>#DIV/0!</v></c><c><v>1e3</v></c></row><row r="9"/><row r="10"><c r="D10" t="str"><v>n/a</v></c><c r="B10"/></row>'
    )
    path = _foreign(tmp_path / "f.xlsx", sheet, shared, styles)
    assert workbooks.sheets(path) == [("A & B", "xl/worksheets/other.xml")]
    cells = {(r.row, r.column): r for r in workbooks.read_workbook(spark, path, header=1).collect()}
    assert set(cells) == {(4, 0), (4, 1), (4, 3), (4, 26), (5, 0), (5, 1), (5, 3), (9, 3)}
    assert cells[4, 0].text == "rich" and cells[4, 0].header == "name" and cells[4, 1].time == datetime.datetime(2020, 1, 1, 12) and cells[4, 3].number == 2
    assert cells[4, 26].header == "v.1" and cells[4, 26].text == "TRUE" and cells[5, 3].text == "1000" and cells[5, 1].time == datetime.datetime(2020, 2, 3)
    typed = workbooks.read_workbook(spark, path, "name string, when timestamp_ntz, v double, `v.1` boolean, none long, row long, sheet string", header=1).orderBy("row").collect()
    assert [tuple(r)[2:] for r in typed] == [(2.0, True, None, 4, "A & B"), (1000.0, None, None, 5, "A & B"), (None, None, None, 9, "A & B")]
    # a name that the header lacks
    assert typed[0].name == "rich" and typed[1].name == "" and typed[2].when is None
    old = _foreign(tmp_path / "old.xlsx", '<row r="1"><c r="A1" t="str"><v>t</v></c></row><row r="2"><c r="A2" s="1"><v>1</v></c></row>', "", styles, '<x:workbookPr date1904="1"/>')
    assert workbooks.read_workbook(spark, old, "t timestamp_ntz").first().t == datetime.datetime(1904, 1, 2)
    with pytest.raises(Exception, match="type that no cell has"):
        workbooks.read_workbook(spark, path, "name array<int>").count()


@pytest.mark.parametrize("shared", [False, True])
def test_round_trip(spark, tmp_path, shared):
    rows = [(f"b{i % 3}", f"s<{i % 7}>", i, None if i % 5 == 0 else i / 3, f"t&{i}\n é" if i % 4 else None, datetime.datetime(2001, 1, 1) + datetime.timedelta(hours=7 * i), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "workbook string, sheet string, n long, x double, t string, at timestamp_ntz, flag boolean").repartition(4)
    files = [r.path for r in workbooks.write_workbooks(df, str(tmp_path), ["n"], title_rows=2, shared=shared).collect()]
    assert len(files) == 3 and all(len(workbooks.sheets(f)) == 7 for f in files)
    back = workbooks.read_workbook(spark, files, "sheet string, row long, n long, x double, t string, at timestamp_ntz, flag boolean", header=2)
    assert back.rdd.getNumPartitions() == 21
    key = lambda r: r[1]
    assert sorted([tuple(r) for r in back.drop("row").collect()], key=key) == sorted([r[1:] for r in rows], key=key)
    assert back.groupBy("sheet").agg(F.min("row").alias("m")).where("m <> 3").count() == 0
    assert workbooks.read_workbook(spark, files, header=2, pattern="^none$").count() == 0


def test_150_sheets_of_series(spark, sf_dir, tmp_path):
    """Members by 150 sheets in one workbook; a sheet is read as a partition of its own."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("w").alias("workbook"), F.format_string("51-%d_1-%d", F.col("l_orderkey") % 3, F.col("l_orderkey") % 150).alias("sheet"), "l_orderkey", "l_linenumber", "l_extendedprice")
    files = [r.path for r in workbooks.write_workbooks(line, str(tmp_path), ["l_orderkey", "l_linenumber"]).collect()]
    back = workbooks.read_workbook(spark, files[0], "sheet string, l_orderkey long, l_linenumber long, l_extendedprice double")
    assert back.rdd.getNumPartitions() == 150
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, line.drop("workbook").collect()))


def test_rows_of_a_large_sheet_are_not_held(tmp_path):
    path = str(tmp_path / "large.xlsx")
    with open(path, "wb") as f:
        w = workbooks.WorkbookWriter(f)
        w.sheet("s")
        for i in range(60_000):
            w.row([i, f"text {i}", i / 7])
        w.close()
    (_, member), = workbooks.sheets(path)
    tracemalloc.start()
    total = sum(cells[0] for _, cells in workbooks.rows(path, member))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 60_000 * 59_999 / 2 and peak < 4 << 20


def test_sheets_that_name_no_cluster(spark, tmp_path):
    df = spark.createDataFrame([("w", "Sheet one", 1.0, 2.0)], "workbook string, sheet string, MODEL double, SEED double")
    path = workbooks.write_workbooks(df, str(tmp_path), ["MODEL"]).first().path
    with pytest.raises(ValueError, match="name no cluster"):
        workbooks.parameters_workbook(spark, path, [], 0)


def test_wells_and_missing_columns(spark, tmp_path):
    """A column that only a later sheet has, texts in place of numbers, a duplicate name and wells that are none."""
    rows = [("w", "51-1_1-1", "2001-12-31", "3", "x", 1.0), ("w", "51-1_1-2", "2001-12-31", "bad", "5", 2.0)]
    df = spark.createDataFrame(rows, "workbook string, sheet string, `Date` string, `oil (WELL1)` string, `oil (WELL 2)` string, `water (INJ1)` double")
    path = workbooks.write_workbooks(df, str(tmp_path), ["Date"]).first().path
    assert workbooks.wells_of(spark, path) == ["INJ1", "WELL1"]
    got = sorted(map(tuple, workbooks.dynamics_workbook(spark, path, ["oil", "water"], "Date").drop("time").collect()))
    assert got == [("51-1_1-1", "oil", "INJ1", 0.0), ("51-1_1-1", "oil", "WELL1", 3.0), ("51-1_1-1", "water", "INJ1", 1.0), ("51-1_1-1", "water", "WELL1", 0.0), ("51-1_1-2", "oil", "INJ1", 0.0), ("51-1_1-2", "oil", "WELL1", 0.0), ("51-1_1-2", "water", "INJ1", 2.0), ("51-1_1-2", "water", "WELL1", 0.0)]


def test_large_sheets_are_continued(spark, sf_dir, monkeypatch):
    """No sheet of s17_workbook_cells has more rows than the format allows, however many lines it gets; the cells are those of all lines."""
    import __spark_entry__

    seen, read = [], workbooks.read_workbook
    monkeypatch.setattr(workbooks, "MOST_ROWS", 60, raising=False)
    monkeypatch.setattr(workbooks, "read_workbook", lambda spark, paths, *a: seen.extend(paths) or read(spark, paths, *a))
    got = {r.sheet: (r.n_cells, r.numbers) for r in __spark_entry__.queries()["s17_workbook_cells"](spark, sf_dir).collect()}
    assert max(at for p in seen for _, member in workbooks.sheets(p) for at, _ in workbooks.rows(p, member)) == 59
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 40).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber") + F.col("l_quantity")).alias("v")).collect()
    assert got == {f"lines-{r.k}": (4 * r.n, r.v) for r in line}


def test_one_workbook_by_many_tasks(spark, tmp_path):
    """A workbook of one sheet is written by all tasks; its files, by path, hold its rows in order."""
    df = spark.range(2000).select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), (F.col("id") * 7 % 2000).alias("n"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = sorted(r.path for r in workbooks.write_workbooks(df, str(tmp_path), ["n"], split=True).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = [[cells[0] for at, cells in workbooks.rows(p, workbooks.sheets(p)[0][1]) if at] for p in files]
    assert len(parts) == 4 and min(map(len, parts)) > 300 and [x for part in parts for x in part] == list(range(2000))


@pytest.mark.parametrize("shared", [False, True])
def test_rows_by_columns_are_rows(tmp_path, shared):
    import pyarrow as pa

    n, day = 300, datetime.date(2001, 2, 3)
    columns = [
        pa.array([None if i % 7 == 0 else i % 5 for i in range(n)], pa.int64()), pa.array([float("nan") if i % 11 == 0 else i / 3 for i in range(n)]), pa.array([i % 2 == 0 for i in range(n)]),
        pa.array([f"<&> \" {i % 3}\n" if i % 4 else None for i in range(n)]), pa.array([day + datetime.timedelta(i % 40) for i in range(n)]), pa.array([datetime.datetime(2020, 1, 1, 5) + datetime.timedelta(hours=i) for i in range(n)], pa.timestamp("us")), pa.nulls(n, pa.string())
    ]
    paths = [str(tmp_path / f"{k}.xlsx") for k in range(2)]
    for k, path in enumerate(paths):
        with open(path, "wb") as f:
            w = workbooks.WorkbookWriter(f, shared)
            w.sheet("s")
            w.row(["a", "b"])
            if k:
                w.rows([c.slice(3, 290) for c in columns], 290)
            else:
                for values in zip(*(c.slice(3, 290).to_pylist() for c in columns), strict=True):
                    w.row(values)
            w.row([1])
            w.close()
    one, two = (list(workbooks.rows(p, workbooks.sheets(p)[0][1])) for p in paths)
    assert one == two and len(one) == 292 and one[6][1][4].day == 11
    with zipfile.ZipFile(paths[0]) as a, zipfile.ZipFile(paths[1]) as b:
        assert shared or a.read("xl/worksheets/sheet1.xml") == b.read("xl/worksheets/sheet1.xml")


PLAIN = "".join(f'<row r="{i}" spans="1:4"><c r="A{i}"><v>{i}</v></c><c r="AB{i}" s="1"/><c r="AC{i}" t="inlineStr"><is><t xml:space="preserve">a &amp; &#x41;&lt;{i} </t></is></c><c r="AD{i}" t="str"><v>x</v></c><c r="AE{i}" t="b"><v>1</v></c><c r="AF{i}" t="e"><v>#N/A</v></c></row>\n' for i in range(1, 40))


@pytest.mark.parametrize("odd", [
    "", '<row r="50"><c r="A50"><f>1+1</f><v>2</v></c></row>', '<!-- </row> --><row r="50"><c r="A50"><v>2</v></c></row>', "<row r='50'><c r='B50'><v>2</v></c></row>", '<row><c><v>4</v></c><c t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c></row>',
    '<row r="50"><c r="A50" t="str"><v><![CDATA[</row>]]></v></c></row>', '<row r="50"/><row r="51"><c t="str" r="C51"><v>a\r\nb</v></c></row>', '<row r="50"><c r="A50" t="inlineStr"><is><t/></is></c><c r="B50"><v></v></c><c r="C50"></c></row>',
    '<row r="50" x="/"><c r="A50" t="inlineStr"><v>3</v></c><c r="B50" t="str"><v>a\rb</v></c></row>',
])
@pytest.mark.parametrize("piece", [37, 700, 1 << 16])
def test_plain_rows_and_others(tmp_path, monkeypatch, odd, piece):
    """Rows as most programs write them, others before, between and after them, in pieces of any size: what the XML parser alone gives."""
    monkeypatch.setattr(workbooks, "_PIECE", piece)
    later = PLAIN.replace('r="', 'r="1').replace('"1A', '"A')  # rows 11 to 139
    for sheet in (PLAIN + odd, odd + later, PLAIN + odd + later):
        path = _foreign(tmp_path / "x.xlsx", sheet)
        got = list(workbooks.rows(path, "xl/worksheets/other.xml"))
        with monkeypatch.context() as m:
            m.setattr(workbooks, "_plain_rows", lambda text: None)
            assert got == list(workbooks.rows(path, "xl/worksheets/other.xml"))
        assert len(got) == sheet.count("<row")
        if sheet.startswith("<row r=\"1\""):
            assert got[1] == (1, {0: 2.0, 28: "a & A<2 ", 29: "x", 30: True})
