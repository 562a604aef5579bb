"""Sources: Word files, corpus folders, structure, cases and snapshots."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.operators import tree
from lexloom.sources import corpus, structure, word

LINES = """BỘ THỬ NGHIỆM
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
Thông tư này quy định:
1. Khoản một:
a) Điểm a;
đ) Điểm đ.
Đoạn cuối của khoản.
2. Sửa đổi như sau: “Điều 9. Trong ngoặc
1. vẫn trong ngoặc”.
Điều 2. Tên điều
Nội dung.
Nơi nhận:
- Lưu.
Phụ lục
DANH MỤC
I. Nhóm một
1.1. Mục con
Mẫu số 01
ĐƠN ĐỀ NGHỊ"""


def test_structure(spark):
    found = {c["path"].removeprefix("d."): c for c in structure.chunks(LINES, "D", "Tên")}
    assert list(found) == ["pre_1", "c_i.a_1.body", "c_i.a_1.c_1.body", "c_i.a_1.c_1.p_a", "c_i.a_1.c_1.p_dd", "c_i.a_1.c_1.tail_1", "c_i.a_1.c_2", "c_i.a_2", "postamble", "app_u1.i_i", "app_u1.i_1_1"]
    assert found["c_i.a_1.c_2"]["end_line"] == 11 and json.loads(found["c_i.a_2"]["metadata"])["article_title"] == "Tên điều"
    assert found["c_i.a_1.c_1.p_a"]["contextualized_text"] == "[Tên] > [Chương I] > [Điều 1. Phạm vi] > [Khoản 1]\nThông tư này quy định:\na) Điểm a;"
    docs = spark.createDataFrame([("D", "Tên", LINES), ("E", None, ""), (None, None, None), ("F", "x", None)], "doc_code string, title string, raw_text string")
    made = structure.chunk_documents(docs)
    assert made.count() == 11 and tree.repeated_paths(made).count() == 0
    uncovered = tree.line_coverage(spark.createDataFrame([("D", 21)], "doc_code string, n_lines long"), made).select("line")
    assert sorted(r.line for r in uncovered.collect()) == structure.exempt_lines(LINES) == [2, 3, 4, 12, 16, 17, 20, 21]


def test_windows_keep_every_line_once_and_repeat_table_heads():
    lines = ["caption", "| a | b |", *[f"| {k} | x |" for k in range(30)], "y" * 90, "end"]
    got = list(structure.window_lines(lines, list(range(len(lines))), 80))
    assert [n for w, _ in got for n in w] == list(range(len(lines)))
    assert got[0][1] == [] and got[1][1] == ["caption", "| a | b |"] and got[-1][1] == [] and ([32], []) in got
    assert all(sum(len(lines[n]) + 1 for n in w) + sum(len(x) + 1 for x in stem) <= 81 for w, stem in got if w != [32])
    ruled = ["Bảng 1", "| a | b |", "|---|---|", *["| 1 | 2 |"] * 20]
    assert list(structure.window_lines(ruled, list(range(23)), 60))[-1][1] == ["Bảng 1", "| a | b |", "|---|---|"]
    assert list(structure.window_lines(ruled, list(range(23)), 9999)) == [(list(range(23)), [])]
    assert structure.is_data_table(["| a |", "| 1 |", "| 2 |"]) and not structure.is_data_table(["| a | b | c |", "| | | |", "| 1 | | |"])


def test_quotes():
    assert structure.quote_spans("a “b ‘c’ d” e") == [(2, 11)]
    assert structure.quote_spans("“open\nnext “in” x") == [(0, 5), (11, 15)]
    assert structure.quote_spans('x "y" » z') == [(2, 5)]
    assert structure.quote_spans('“mixed" and "so”') == [(0, 7), (12, 16)]
    assert structure.quote_spans('5" pipe “x”') == [(8, 11)] and structure.quote_spans('("in")') == [(1, 5)]
    assert structure.quote_spans("“a «b” c» d") == [(0, 6)]


def test_contents_lists():
    body = ["Chương I", "Điều 1. Một", "Nội dung"]
    assert structure.without_contents(["Đầu", "MỤC LỤC", "Chương I ..... 3", "Điều 1. Một … 4", *body]) == ["Đầu", *body]
    assert structure.without_contents(["Mục lục", "chữ thường"]) == ["Mục lục", "chữ thường"]
    assert structure.without_contents([]) == []


def test_pages(spark):
    from lexloom.sources import pages

    rows = []
    for page in (1, 2):
        rows.append(("f", page, 10.0, 50.0, 100.0, 9.0, f"Trang {page}", False, False))
        rows += [("f", page, 100.0 + 20 * k, 80.0 if k == 0 else 50.0, 500.0 if k < 2 else 200.0, 12.0, f"p{page} line {k} of text", False, False) for k in range(3)]
        rows.append(("f", page, 160.0, 50.0, 500.0, 12.0, f"p{page} goes on in full", False, False))
        rows.append(("f", page, 101.0, 50.0, 60.0, 7.0, "1", True, True))
        rows.append(("f", page, 700.0, 50.0, 400.0, 8.0, f"{page} note", True, False))
        rows.append(("f", page, 712.0, 50.0, 400.0, 8.0, f"second line {'ab'[page - 1]}", False, False))
    rows.append(("f", 2, 300.0, 50.0, 500.0, 12.0, "zz|~ scanned text without any letter of the language", False, False))
    schema = "path string, page int, top double, x0 double, x1 double, size double, text string, small_digit boolean, marker_only boolean"
    tables = spark.createDataFrame([("f", 2, 400.0, "| a | b |")], "path string, page int, top double, text string")
    got = [(r.kind, r.text) for r in pages.blocks(spark.createDataFrame(rows, schema), tables).orderBy("ordinal").collect()]
    one = lambda p: [("furniture", f"Trang {p}"), ("text", f"p{p} line 0 of text p{p} line 1 of text p{p} line 2 of text"), ("text", f"p{p} goes on in full")]
    notes = lambda p: [("footnote", f"{p} note"), ("footnote", f"second line {'ab'[p - 1]}")]
    assert got == one(1) + notes(1) + one(2) + [("corrupt", "zz|~ scanned text without any letter of the language"), ("table", "| a | b |")] + notes(2)
    assert pages.blocks(spark.createDataFrame([], schema)).count() == 0


def _docx(body: str, numbering: str = "") -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f"<w:numbering {ns}>{numbering}</w:numbering>")
    return out.getvalue()


def test_word(spark):
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{t}</w:t></w:r></w:p>"
    num = lambda level: f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="7"/></w:numPr></w:pPr>'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for k, f, t in ((0, "decimal", "%1."), (1, "lowerLetter", "%2)")))
    numbering = f'<w:abstractNum w:abstractNumId="3">{levels}</w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num>'
    body = (
        p("one", num(0)) + p("a", num(1)) + p("b", num(1)) + p("two", num(0)) + p("again", num(1))
        + "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r><w:r><w:rPr><w:caps/></w:rPr><w:t>up</w:t></w:r></w:p>"
        + "<w:p><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b+c</m:t></m:r></m:den></m:f></m:oMath></w:p>"
        + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('v', '<w:vMerge w:val=\"restart\"/>')}{cell('1')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('2')}</w:tr></w:tbl>"
        + f"<w:tbl><w:tr>{cell('boxed')}</w:tr></w:tbl>"
    )
    old = _docx('<w:p><w:r><w:rPr><w:rFonts w:ascii=".VnTime"/></w:rPr><w:t>®iÒu</w:t></w:r></w:p>')
    new = _docx('<w:p><w:r><w:rPr><w:rFonts w:ascii=".VnTime"/></w:rPr><w:t>Điều</w:t></w:r><w:r><w:sym w:font="Wingdings" w:char="F0FC"/></w:r><w:r><w:rPr><w:rFonts w:ascii="Symbol"/></w:rPr><w:t>\uf061</w:t></w:r></w:p>')
    over = '<w:num w:numId="8"><w:abstractNumId w:val="3"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>'
    five = lambda t: p(t, num(0).replace('w:val="7"', 'w:val="8"'))
    started = _docx(p("one", num(0)) + five("five") + five("six") + p("two", num(0)), numbering + over)
    files = spark.createDataFrame([("a.docx", bytearray(_docx(body, numbering))), ("b.pdf", bytearray(b"x")), ("c.docx", bytearray(b"no zip")), ("d.docx", bytearray(old)), ("e.docx", bytearray(new)), ("f.docx", bytearray(started))], "path string, content binary")
    got = word.extract(files).collect()
    assert [r.text for r in got if r.path == "a.docx"] == ["1. one", "a) a", "b) b", "2. two", "a) again", "UP", "a/(b+c)", "| h1 | h2 |", "| v | 1 |", "| v | 2 |", "boxed"]
    assert [r.text for r in got if r.path == "e.docx"] == ["Điều✓α"] and [r.text for r in got if r.path == "f.docx"] == ["1. one", "5. five", "6. six", "2. two"]
    assert {r.path for r in got if r.kind == "error"} == {"b.pdf", "c.docx", "d.docx"}
    text = corpus.canonical_text(word.extract(files.filter("path < 'e'"))).collect()
    assert len(text) == 1 and text[0].raw_text.split("\n")[-1] == "boxed"
    assert [word.letters(28), word.roman(1994)] == ["bb", "mcmxciv"]


def test_corpus_cases_and_snapshot(spark, tmp_path):
    for name, meta in (("a", {"doc_code": "A", "title": "t", "effective_date": "2020-01-01", "parts": ["x"], "notes": "n"}), ("b", {"doc_code": "B", "title": "t", "effective_date": "2020-01-01", "parts": ["x"], "in_force": False})):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / "meta.json").write_text(json.dumps(meta))
    (tmp_path / "m" / "c").mkdir()
    (tmp_path / "m" / "c" / "meta.json").write_text("{no json")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    rows = {r.label: r for r in corpus.load_corpus(spark, str(tmp_path / "m"), str(tmp_path / "t")).collect()}
    assert rows["a"].error is None and rows["a"].raw_text == "one\ntwo" and rows["b"].error == "not in force without expiration_date" and rows["c"].error == "doc_code is missing"
    links = corpus.document_links(spark.createDataFrame([("A", ["http://x.org/1", "https://law.gov.vn/2", "https://gov.vn/3", "not a url"])], "doc_code string, source_urls array<string>"), ("gov.vn",))
    assert [tuple(r) for r in links.collect()] == [("A", "gov.vn", "https://law.gov.vn/2")]
    (tmp_path / "c.jsonl").write_text('{"id": "u1", "expected": ["a.b"]}\n{"id": "u1"}\n')
    with pytest.raises(Exception, match="repeated or missing id"):
        corpus.load_cases(spark, str(tmp_path / "c.jsonl"), corpus.ANSWER_CASE).collect()
    chunks = spark.createDataFrame([(1, "a", [1.0, 0.1]), (2, None, [0.0, 2.0])], "id long, text string, embedding array<float>")
    where, schema = str(tmp_path / "s"), {"chunks": "id long, text string, embedding array<float>"}
    corpus.export_snapshot({"chunks": chunks}, where, "m", 2)
    back = corpus.import_snapshot(spark, where, schema, "m", 2)["chunks"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect()))
    assert corpus.embedding_cache(back, "m", 2).count() == 2
    with pytest.raises(ValueError, match="header"):
        corpus.import_snapshot(spark, where, schema, "other", 2)
    with pytest.raises(ValueError, match="no vector"):
        corpus.export_snapshot({"chunks": chunks.withColumn("embedding", F.lit(None).cast("array<float>"))}, where, "m", 2)
