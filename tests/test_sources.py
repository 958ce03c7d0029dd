import io
import json
import zipfile

import pytest

from skeinmill.operators import assistant, cleaning
from skeinmill.sources import objects, readers

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(r1="worksheets/s1.xml", r2="/xl/worksheets/s2.xml"),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>ka</t></r><r><t>le</t></r></si></sst>",
    "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row/><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>size</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": f"<worksheet {S}><sheetData/></worksheet>",
})
PPTX = zipped({
    "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(r1="slides/s1.xml", r2="slides/s2.xml"),
    "ppt/slides/s1.xml": f"<p:sld {P}><p:sp><p:txBody><a:p><a:r><a:t>Hello </a:t></a:r><a:r><a:t>you</a:t></a:r></a:p><a:p/></p:txBody></p:sp></p:sld>",
    "ppt/slides/s2.xml": f"<p:sld {P}><a:tbl><a:tr><a:tc><a:t>k</a:t></a:tc></a:tr><a:tr><a:tc><a:t>v</a:t></a:tc></a:tr></a:tbl></p:sld>",
})
DOCX = zipped({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p>'
    "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
})


def test_office_files():
    assert readers.xlsx_to_markdown(XLSX) == "## Sheet: One\n\n\nname：kale size：3\n\n---\n\n## Sheet: Two\n"
    assert readers.pptx_to_markdown(PPTX) == "## Slide 1\n\n\nHello you\n\n---\n\n## Slide 2\n\n\nk：v"
    assert readers.docx_to_markdown(DOCX) == "## Head\n\ntext\n\n- item\n\nk：v"


def test_json_and_html():
    assert readers.json_to_markdown('{"a": 1, "b": [1, 2]}') == "# a\n\n| a | b        |\n|:--|:---------|\n| 1 | \n- 1\n- 2 |"
    deep = {"title": "x" * 25, "more": {"k": "y" * 22, "n": None}, "few": [1]}
    assert readers.json_to_markdown(json.dumps(deep), "T") == f"# T\n\n## title\n\n{'x' * 25}\n\n## more\n\n### k\n\n{'y' * 22}\n\n### n\n## few\n\n\n- 1"
    page = "<html><head><title>t</title><script>x</script></head><body><h2>H</h2><p>a <a href='/u'>link</a><img src=x> <em>e</em></p><ol><li>one<li>two</ol><table><tr><th>k<th>l</tr><tr><td>1<td></tr></table>tail"
    assert readers.html_to_markdown(page).startswith("## H\n\na [link](/u) *e*\n\n1. one\n2. two")
    assert readers.html_to_markdown("<table><tr><th>k</th><th>l</th></tr><tr><td>1</td><td></td></tr></table>tail") == "k：1\n\ntail"


def test_dispatch_keeps_every_file(spark):
    own = readers.default_converters()
    own.register(".PDF", lambda content, name: "# scanned\n\n" + content.decode())
    files = [("raw/a.xlsx", XLSX), ("raw/b.txt", b"plain"), ("raw/c.md", b"| a |\n|---|"), ("raw/d.pdf", b"text"), ("raw/e.docx", b"no zip"), ("raw/f.exe", b""), ("raw/g.json", None)]
    got = {r.key: r for r in readers.convert_files(spark.createDataFrame(files, "key string, content binary"), own).collect()}
    assert len(got) == 7 and got["raw/b.txt"].markdown == "# b\n\nplain" and got["raw/c.md"].markdown == "| a |\n|---|" and got["raw/d.pdf"].markdown == "# scanned\n\ntext"
    assert got["raw/a.xlsx"].markdown.startswith("## Sheet: One\n\nname：kale") and got["raw/a.xlsx"].error is None
    assert all(got[k].error and "conversion failed" in got[k].markdown for k in ("raw/e.docx", "raw/f.exe", "raw/g.json"))
    with pytest.raises(ValueError):
        own.get("exe")


def test_line_and_chunk_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "x", "text": "one"}\n\n{"text": "two"}\n{broken\n{"id": "x", "text": "one"}\n')
    (tmp_path / "in" / "b.txt").write_text(" whole \nfile ")
    got = {(r.doc_id, r.text) for r in objects.load_line_documents(spark, str(tmp_path / "in")).collect()}
    assert got == {("x", "one"), ("a.jsonl_line3", "two"), ("b.txt", "whole \nfile")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "set.jsonl").write_text('{"question": "q", "ground_truth": "a"}\n{"question": " ", "ground_truth": "a"}\n')
    with pytest.raises(ValueError, match="line 2"):
        objects.load_test_set(spark, str(tmp_path / "t"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.json").write_text('{"doc_uuid": "d", "chunks": [{"index": 0, "text": "x", "title": "T"}]}')
    assert [tuple(r) for r in objects.load_chunk_files(spark, str(tmp_path / "c")).collect()] == [("d", 0, "x", "T")]
    log = spark.createDataFrame([("a", 1)], "key string, pos long")
    objects.append_jsonl(log, str(tmp_path / "log"))
    objects.append_jsonl(log, str(tmp_path / "log"))
    assert objects.read_jsonl(spark, str(tmp_path / "log"), "key string, pos long").count() == 2


def test_store_and_times(spark, tmp_path):
    store = objects.FileStore(spark)
    path = str(tmp_path / "f.bin")
    store.put(path, b"\x00abc")
    assert store.get(path) == b"\x00abc" and store.stat(path)["length"] == 4 and store.delete([path, path]) == 1 and store.stat(path) is None
    assert objects.resolve_time_range(days=2, now=200_000) == (27_200, 200_000) and objects.resolve_time_range(start="5", end=None) == (5, None)
    low, high = objects.resolve_time_range(start="2024-01-01", end="2024-01-01")
    assert high - low == 86_399
    for wrong in ({"days": 1, "start": "5"}, {"days": -1}, {"start": "9", "end": "5"}, {"start": "soon"}):
        with pytest.raises(ValueError):
            objects.resolve_time_range(**wrong)


def test_configuration_tools_and_skills():
    assert assistant.interpolated({"a": ["${X:-d}", "${Y}"]}, {"Y": "y"}) == {"a": ["d", "y"]}
    with pytest.raises(KeyError):
        assistant.interpolated("${NONE_SUCH}", {})
    assert assistant.typed({"B": "Yes"}, "B", bool) and assistant.typed({"L": "a, b"}, "L", list) == ["a", "b"] and assistant.typed({}, "N", int, 3) == 3
    with pytest.raises(ValueError):
        assistant.typed({"N": "9"}, "N", int, most=5)
    tools = assistant.Tools()
    tools.tool("add", {"type": "object"}, "math")(lambda a, b: {"sum": a + b})
    assert json.loads(tools.execute("add", '{"a": 1, "b": 2}')) == {"sum": 3} and "error" in tools.execute("add", "{") and "error" in tools.execute("none", {})
    assert [t["function"]["name"] for t in tools.schemas()] == ["add"] and tools.schemas(lambda g: g != "math") == []
    skill = assistant.parse_skill("---\nname: n\nversion: '1'\nsummary: s\n---\n# B\n## Tool: look\nRequired fields:\n\n- `sku`\n- `day`\n\nOptional fields:\n- `w`\n## Tool: other\nClarification:\n- Which?\n")
    assert skill["tools"] == {"look": {"required": ["sku", "day"], "optional": ["w"], "clarification": ""}, "other": {"required": [], "optional": [], "clarification": "Which?"}}
    waits, left = [], [1, 2]

    def fails():
        if left:
            raise OSError(left.pop())
        return "done"

    assert assistant.retried(fails, lambda e: isinstance(e, OSError), sleep=waits.append) == "done" and len(waits) == 2 and 0.5 <= waits[0] <= 0.8 and 1 <= waits[1] <= 1.3
    assert assistant.token_counter(None)("four") == 4


def test_finalisation():
    assert cleaning.finalized("<p>x</p>", lambda t: "x") == "<p>x</p>"
    assert cleaning.cleaned_for_pipeline("a​b  c\n-\n") == "ab c"
