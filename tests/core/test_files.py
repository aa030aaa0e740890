import io
import zipfile

from foliant.sources import files, golden, web


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = {
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>body </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p>"
    "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>K</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>V</w:t></w:r></w:p></w:tc></w:tr>"
    "<w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "docProps/core.xml": "<c xmlns:d='http://d'><d:title>My title</d:title></c>",
}
XLSX = {
    "xl/sharedStrings.xml": "<sst><si><t>Region</t></si><si><t>North</t></si></sst>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>Sales</t></is></c></row><row><c r='A2' t='s'><v>1</v></c><c r='B2'><v>5</v></c></row>"
    "<row><c r='B3'><v>7</v></c></row></sheetData><mergeCells><mergeCell ref='A2:A3'/></mergeCells></worksheet>",
}
PPTX = {
    "ppt/slides/slide1.xml": "<s xmlns:a='http://a'><a:p><a:r><a:t>First</a:t></a:r></a:p></s>", "ppt/slides/slide10.xml": "<s xmlns:a='http://a'><a:p><a:r><a:t>Tenth</a:t></a:r></a:p></s>",
    "ppt/slides/slide2.xml": "<s xmlns:a='http://a'><a:p><a:r><a:t>Second</a:t></a:r></a:p></s>", "ppt/notesSlides/notesSlide2.xml": "<s xmlns:a='http://a'><a:p><a:r><a:t>say this</a:t></a:r></a:p></s>",
}


def test_every_format_in_one_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grün\r\n\r\nzwei".encode("latin-1"))
    (tmp_path / "b.csv").write_text("Name,Amount\nRent,100\n,\nFood,\n")
    (tmp_path / "c.html").write_text("<html><head><title>t</title><style>x{}</style></head><body><nav>menu</nav><p>Hello <b>you</b></p><script>1</script><p>there</p></body></html>")
    (tmp_path / "d.docx").write_bytes(zipped(DOCX))
    (tmp_path / "e.xlsx").write_bytes(zipped(XLSX))
    (tmp_path / "f.pptx").write_bytes(zipped(PPTX))
    (tmp_path / "g.docx").write_bytes(b"not a zip")
    (tmp_path / "h.exe").write_bytes(b"x")
    rows = files.parse(files.list_files(spark, str(tmp_path))).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r["page_number"] or 0):
        text.setdefault(r["filename"], []).append(r["content"])
    assert text["a.txt"] == ["Grün\n\nzwei"] and text["b.csv"] == ["Name: Rent | Amount: 100\nName: Food"] and text["c.html"] == ["Hello you\nthere"]
    assert text["d.docx"] == ["One\n\nbody text", "Two\n\nK: a | V: 1"] and text["e.xlsx"] == ["Region: North | Sales: 5\nRegion: North | Sales: 7"]
    assert text["f.pptx"] == ["First", "Second\nNotes: say this", "Tenth"] and "h.exe" not in text
    assert next(r for r in rows if r["filename"] == "g.docx")["error"].startswith("BadZipFile")
    assert next(r for r in rows if r["filename"] == "d.docx")["extra"] == {"doc_title": "My title"}


def test_golden_files(spark, tmp_path):
    (tmp_path / "golden_dataset_01.json").write_text('[{"id": "q1", "category": "direct", "question": "?"}]')
    (tmp_path / "golden_dataset_02.json").write_text('{"questions": [{"id": "q1", "category": "numerical", "question": "?", "required_fact_groups": [["a"]]}]}')
    got = golden.load(spark, {f"{tmp_path}/golden_dataset_0{i}.json": f"{i}.pdf" for i in (1, 2)}).orderBy("id").collect()
    assert [(r["id"], r["category"], r["source_file"]) for r in got] == [("d01_q1", "direct_fact_lookup", "1.pdf"), ("d02_q1", "numerical_financial", "2.pdf")]


def test_crawl_stays_breadth_first(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "a"), ("d", "e")], "src string, dst string")
    got = web.crawl(edges, spark.createDataFrame([("a",)], "url string"), 4).orderBy("page_number").collect()
    assert [(r["url"], r["level"]) for r in got] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_row_pages_of_large_tables_are_whole(spark, tmp_path):
    from foliant.plans.pages import table_row_pages

    rows = spark.range(1, 20_121).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'m' AS c_mktsegment", "1 AS c_nationkey")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    assert table_row_pages(spark, str(tmp_path)).count() == 403
