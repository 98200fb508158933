import zipfile

from pyspark.sql import functions as F

from lumora.sources import files
from lumora.sources.catalog import Catalog, fingerprint


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "in" / "b.bin").write_bytes(b"ok\xff")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>')
    rows = {r.uri.rpartition("/")[2]: (r.contents, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == ("héllo", None) and rows["b.bin"][0] == "ok�" and rows["c.docx"][0] == "one two\nthree"
    assert rows["bad.docx"][0] is None and "BadZipFile" in rows["bad.docx"][1]
    found = files.search(files.read_documents(spark, str(tmp_path)), F.col("contents").contains("two"), snippet=3).collect()
    assert [r.snippet for r in found] == ["one"]


def test_workbooks_and_slides(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>name</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></s>')
        cells = '<c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c>', '<c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<w xmlns="u"><sheetData><row>{cells[0]}</row><row>{cells[1]}</row></sheetData></w>')
        z.writestr("xl/worksheets/sheet10.xml", '<w xmlns="u"><row><c r="A1"><v>9</v></c></row></w>')
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<d xmlns="u"><p><r><t>first</t></r></p><p><t>second</t></p></d>')
    rows = {r.uri.rpartition("/")[2]: (r.contents, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.xlsx": ("name\t\t3.5\ntwo parts\tTRUE\tin\n9", None), "b.pptx": ("first\nsecond", None)}


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert files.preview(df, 1)[0] == 2 and dict(df.dtypes) == {"a": "int", "b": "string"}


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    df = spark.range(5)
    assert catalog.find("index", "d", "flat") is None
    catalog.save(df, "index", "d", "flat", str(tmp_path / "flat"), source=list(fingerprint(df)))
    assert catalog.find("index", "d", "flat", of=df).count() == 5
    assert catalog.find("index", "d", "flat", of=spark.range(6)) is None
    catalog.mark_stale("index", "d", "flat")
    assert catalog.find("index", "d", "flat") is None and catalog.entries().count() == 1
    catalog.remove("index", "d", "flat")
    assert catalog.entries().count() == 0
