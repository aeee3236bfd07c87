"""Front ends and renderer, without Spark."""

import io
import zipfile

import pytest

from quire import registry
from quire.errors import ConvertError
from quire.formats import csv, data, html, mail, notebook, office, subtitle
from quire.headers import infer, kind
from quire.model import Anchor, Break, Cell, Code, Document, Grid, Heading, Image, Item, Link, ListBlock, Note, NoteRef, Paragraph, Quote, Rule, Style, Text, para, table_of
from quire.render import Place, escape, fence, format_url, html_id, slug, to_markdown


def md(*blocks, notes=()):
    return to_markdown(Document(list(blocks), list(notes)))


def test_csv():
    quoted = b'city,motto,rank\n"  Oslo ","north, and cold",11\nLima,"two\nrows",7\n'
    assert to_markdown(csv.parse(quoted)) == "| city | motto | rank |\n| --- | --- | --- |\n| Oslo | north, and cold | 11 |\n| Lima | two rows | 7 |\n"
    assert csv.sniff_delimiter('a;b;c\n"1,5";"2,5";x\n') == ";"
    assert list(csv.records('a,"b""c"d\r\n\r\nx,"y', ",")) == [["a", 'b"cd'], ["x", "y"]]
    assert list(csv.records("a,\n", ",")) == [["a", ""]]
    assert to_markdown(csv.parse("a\tb\n1\t2\n".encode("utf-16"))) == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert csv.parse(b"").blocks == []


def test_header_inference():
    assert infer(table_of([["Kind", "Value"], ["Percent", "15.5%"], ["Tiny", "0.1"]])) == 1
    assert infer(table_of([["1", "2"], ["3", "4"]])) == 0
    assert infer(table_of([["a", "a"], ["b", "c"]])) == 0
    assert infer(table_of([["a", "b"]])) == 0
    assert [kind(x) for x in ("1,234", "15.5%", "TRUE", "2026-03-15", "26:30:15", "2026-03-15T10:00:00Z", "x", " ")] == ["number", "number", "bool", "date", "date", "date", "text", None]


def test_grid_takes_every_position_once():
    grid = Grid()
    grid.row()
    grid.place(Cell([para("a")], 2, 2))
    grid.place(Cell([para("b")]))
    grid.row()
    grid.place(Cell([para("c")]))
    grid.row()
    grid.place(Cell([para("d")], 20_000, 1))
    table = grid.finish()
    assert [len(row) for row in table.grid] == [3, 3, 1]
    assert sum(isinstance(s, Cell) for row in table.grid for s in row) == 4


@pytest.mark.parametrize(
    ("text", "place", "wanted"),
    [
        ("5*6*7", Place(), "5\\*6*7"),
        ("2 * 3", Place(), "2 * 3"),
        ("two_part_key", Place(), "two_part_key"),
        ("_lead_", Place(), "\\_lead_"),
        ("42. answer", Place(line_start=True), "42\\. answer"),
        ("42.answer", Place(line_start=True), "42.answer"),
        ("### deep", Place(line_start=True), "\\### deep"),
        ("#tag", Place(line_start=True), "#tag"),
        ("+ more", Place(line_start=True), "\\+ more"),
        ("text\n====", Place(), "text\n\\===="),
        ("-----", Place(line_start=True), "\\-----"),
        (">> said", Place(line_start=True), "\\>> said"),
        ("left|right", Place("cell"), "left\\|right"),
        ("left|right", Place(), "left|right"),
        ("</em> 3 <4", Place(), "\\</em> 3 <4"),
        ("&copy; R&D &;", Place(), "&amp;copy; R&D &;"),
        ("see [note] [", Place(), "see \\[note] ["),
        ("[note]", Place(label=True), "\\[note\\]"),
        ("hey!", Place(before_markup=True), "hey\\!"),
        ("~one~ `two", Place(), "\\~one~ `two"),
        ("C:\\dir", Place(), "C:\\\\dir"),
        ("plain`", Place(styled=True), "plain\\`"),
    ],
)
def test_escape(text, place, wanted):
    assert escape(text, place) == wanted


def test_render():
    bold = Style(bold=True)
    assert md(Heading(9, [Text("T")])) == "###### T\n"
    assert md(Paragraph([Text("a", bold), Text(" "), Text("b", bold)])) == "**a b**\n"
    assert md(Paragraph([Text("a"), Break(), Text("b"), Break()])) == "a\\\nb\n"
    assert md(Paragraph([Text("x`y", Style(code=True))])) == "``x`y``\n"
    assert md(Paragraph([Link([Text("t")], "a b")])) == "[t](<a b>)\n"
    assert md(Paragraph([Image("alt", "i.png")])) == "![alt](i.png)\n"
    assert md(ListBlock("lowerAlpha", 2, [Item([para("x")]), Item([para("y")], checked=True)])) == "- b. x\n- c. [x] y\n"
    assert md(ListBlock("decimal", 9, [Item([para("x")]), Item([para("y"), Code("z")])])) == "9. x\n\n10. y\n\n    ```\n    z\n    ```\n"
    assert md(Quote([para("a"), para("b")]), Rule()) == "> a\n>\n> b\n\n---\n"
    assert md(Heading(1, [Text("A B")], "x"), Heading(1, [Text("A B")]), Paragraph([Link([Text("go")], "x", "anchor")])) == "# A B\n\n# A B\n\n[go](#a-b)\n"
    assert md(Paragraph([Anchor("Q 1"), Text("t")]), Paragraph([Link([Text("go")], "Q 1", "anchor")])) == '<a id="q-1"></a>t\n\n[go](#q-1)\n'
    notes = [Note("b", [para("two")]), Note("a", [para("one"), Paragraph([NoteRef("b")])]), Note("c", [para("  ")])]
    assert md(Paragraph([Text("t"), NoteRef("a"), NoteRef("c")]), notes=notes) == "t[^1]\n\n[^1]: one\n\n    [^2]\n\n[^2]: two\n"
    assert fence("a```b", 3) == "````"
    assert (slug(" Ünïcode & Co-op "), slug("!!"), html_id("A  b__-"), format_url("a|b(c)")) == ("ünïcode--co-op", "section", "a-b__", "<a%7Cb(c)>")


def test_data():
    assert data.convert(b'{"a":1,"b":null,"c":true,"d":1.50}', "dir/t.json") == "# t\n\n- a: 1\n- b:\n- c: true\n- d: 1.5\n"
    assert data.convert(b'[{"a":1},{"a":"x|y"}]', None) == "| a |\n| --- |\n| 1 |\n| x\\|y |\n"
    assert data.convert(b'{"a":[1,{}]}', None) == '```json\n{\n  "a": [\n    1,\n    {}\n  ]\n}\n```\n'
    assert data.convert(b'{"a":1}\n{"a":2}\n', None) == "| a |\n| --- |\n| 1 |\n| 2 |\n"
    assert data.convert(b"<a><b>t</b></a>", "x.xml") == "```xml\n<a>\n  <b>t</b>\n</a>\n```\n"
    assert [data.opens_json(x) for x in (b"[ti:x]", b"{0}{25}x", b"[1, 2]", b"[00:12]x", b"{}", b'{"')] == [False, False, True, False, True, True]
    with pytest.raises(ConvertError, match="malformed document: jsonl line 2"):
        data.convert(b'{"a":1}\n{', "x.jsonl")
    with pytest.raises(ConvertError) as caught:
        data.convert(b"\xff", "x.json")
    assert caught.value.code == "malformed"
    assert [data.number(x) for x in (1e21, 1.5e-7, 0.00001, -0.0, 123456789012.5)] == ["1e+21", "1.5e-7", "0.00001", "0", "123456789012.5"]


def test_subtitles():
    cues = lambda raw: subtitle.cues(raw)
    assert cues(b"1\n00:00:01,500 --> 00:00:02,000\n<i>Hi</i> &amp;\nyou\n\nNOTE x\ny\n") == [("00:00:01.500", "Hi & you")]
    assert cues(b"WEBVTT\n\n00:01.000 --> 00:02.000\nx\n") == [("00:00:01.000", "x")]
    assert cues(b"[Script Info]\n[Events]\nFormat: Start, Text\nDialogue: 0:00:01.20,{\\i1}a\\Nb, c\n") == [("00:00:01.200", "a b, c")]
    assert cues(b"[00:01.5][00:03.25]la\n") == [("00:00:01.500", "la"), ("00:00:03.250", "la")]
    assert cues(b"{0}{25}10 fps\n{50}{75}a|b\n") == [("00:00:05.000", "a b")]
    assert cues(b"[15][20]/a|b\n") == [("00:00:01.500", "a b")]
    assert cues(b"0:00:01.5,0:00:02.0\nx\n") == [("00:00:01.500", "x")]
    assert cues(b"#timeres 10\n@15 @20 VL {c} x\n@25 @30 JC {c} y\n@35 @40 cc z\n@45 @50 vx w\n") == [("00:00:01.500", "x"), ("00:00:02.500", "y"), ("00:00:03.500", "z"), ("00:00:04.500", "vx w")]
    assert cues(b"0:00:01.50 0:00:02.00 D one\\\n  two\\nthree\n") == [("00:00:01.500", "D onetwo three")]
    assert cues(b"3\n01:02:03,045 --> 01:02:04,000 X1:5\nfirst\n4\n00:05.006 --> 00:06.000\nsecond &#x41;&bogus;\n") == [("01:02:03.045", "first"), ("00:00:05.006", "second A&bogus;")]
    assert cues(b"WEBVTT x\nKind: y\n\nSTYLE\n::cue {}\n\nname\n00:01.000 --> 00:02.000\n<v Ann>hi</v>\n") == [("00:00:01.000", "hi")]
    assert cues(b"[la:en]\n[-0:01.00]no\n[1:02:03.5]yes\n") == [("00:00:01.000", "no"), ("01:02:03.500", "yes")]
    assert cues(b"<tt:tt xmlns='ttml'><tt:p begin='00:01:02.25'>a</tt:p><tt:p begin='x'>b</tt:p></tt:tt>") == []
    assert cues(b"<tt xmlns='ttml'><p begin='00:01:02.25'>a</p><p begin='x'>b</p></tt>") == [("00:01:02.250", "a")]
    assert cues(b'<tt xmlns="x"><p begin="1.5s">a<br/>b</p></tt>') == [("00:00:01.500", "a b")]


def test_html():
    page = html.document
    assert to_markdown(page("<h1 id=x>Hi</h1><p>go <a href='#x'>there</a> <s>no</s><p>two")) == "# Hi\n\ngo [there](#hi) ~~no~~\n\ntwo\n"
    assert to_markdown(page("<ol start=3><li>a<li value=7>b</ol>")) == "3. a\n\n7. b\n"
    assert to_markdown(page("<table><tr><th>A<th>B<tr><td>1<td>2</table>")) == "| A | B |\n| --- | --- |\n| 1 | 2 |\n"
    assert to_markdown(page('<style>.h{display:none} b.x{font-weight:normal !important}</style><p class=h>no<p><b class=x>plain</b>')) == "plain\n"
    assert to_markdown(page('<pre><code class="language-py">a\nb\n</code></pre>')) == "```py\na\nb\n```\n"
    assert to_markdown(page('<script>"</p>"</script><p>&copy; &bogus; &#65;')) == "© &amp;bogus; A\n"


def test_mail_and_notebook():
    raw = b"From: a@b\nSubject: S\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain\n\na\nb\n--x\nContent-Type: x/y\nContent-Disposition: attachment; filename=q.pdf\n\nz\n--x--\n"
    assert to_markdown(mail.parse(raw)) == "# S\n\nFrom\\\n: a@b\n\na\\\nb\n\n## Attachments\n\n- q.pdf\n"
    box = b"From x\nSubject: 1\n\na\n\nFrom y\nSubject: 2\n\n>From b\n"
    assert to_markdown(mail.parse(box)) == "# 1\n\na\n\n---\n\n# 2\n\nFrom b\n"
    cells = b'{"nbformat":4,"cells":[{"cell_type":"markdown","source":["# T\\n","x `y`"]},{"cell_type":"code","source":"1","outputs":[{"output_type":"error","ename":"E","evalue":"v"}]}]}'
    assert to_markdown(notebook.parse(cells)) == "# T\n\nx `y`\n\n```python\n1\n```\n\n```\nE: v\n```\n"
    blocks = notebook.small_markdown("## Two ##\n#none\nmore\n- a\n- b\n---\n2) c\n> q\n>r\n~~~ py\n# x\n\ny\n~~~\n# C#\nend")
    assert to_markdown(Document(blocks)) == "## Two\n\n#none\nmore\n\n- a\n- b\n\n---\n\n1. c\n\n> q\n> r\n\n```py\n# x\n\ny\n```\n\n# C#\n\nend\n"
    with pytest.raises(ConvertError, match="not a Jupyter notebook"):
        notebook.parse(b"{}")


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archive_and_office():
    inner = zipped({"a.csv": "a,b\n1,2\n", "__MACOSX/x": "no", "d/": "", "c.bin": b"\0\1"})
    found, text = registry.convert(inner, "x.zip")
    assert (found, text) == ("zip", "## a.csv\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n## c.bin\n\ncould not convert: unsupported input: unrecognized file content and extension: c.bin\n")
    word = zipped({"word/document.xml": '<w:document><w:body><w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r></w:p></w:body></w:document>'})
    assert registry.convert(word) == ("docx", "# T\n\n**x**\n")
    sheet = zipped({
        "xl/workbook.xml": '<workbook><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": "<sst><si><t>Day</t></si></sst>",
        "xl/worksheets/s.xml": '<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="B3" s="1"><v>46096</v></c></row></sheetData></worksheet>',
    })
    assert registry.convert(sheet) == ("xlsx", "| Day |\n| --- |\n| 2026-03-15 |\n")
    book = zipped({
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>',
        "o/b.opf": '<package><metadata><dc:title>B</dc:title></metadata><manifest><item id="c" href="c.html"/></manifest><spine><itemref idref="c"/></spine></package>',
        "o/c.html": "<html><body><p>x</p></body></html>",
    })
    assert registry.convert(book) == ("epub", "# B\n\nx\n")
    fiction = b"<FictionBook><description><title-info><book-title>B</book-title></title-info></description><body><section><title><p>C</p></title><p>x <emphasis>y</emphasis></p></section></body></FictionBook>"
    assert registry.convert(fiction) == ("fb2", "# B\n\n## C\n\nx *y*\n")
    assert (office.float_text(0.1 + 0.2), office.serial_text(0.5, "datetime"), office.serial_text(1.25, "timedelta"), office.duration_text("PT26H30M15S")) == ("0.3", "12:00:00", "30:00:00", "26:30:15")


@pytest.mark.parametrize(
    ("raw", "path", "wanted"),
    [
        (b"a,b", "x.csv", "csv"),
        (b"plain", "x.txt", "text"),
        (b'{"a":1}', None, "data"),
        (b"[ti:x]\n[00:01.00]a", "x.lrc", "subtitle"),
        (b"<!doctype html><p>x", None, "html"),
        (b"From: a\nMIME-Version: 1.0\n\nx", None, "email"),
        (b"---\nfrom: x\n", "x.yaml", "data"),
        (b'<svg xmlns="http://www.w3.org/2000/svg"/>', None, "svg"),
        (b"\0\1", None, None),
    ],
)
def test_detection(raw, path, wanted):
    assert registry.detect(raw, path) == wanted


def test_refusals():
    for raw, path, message in ((b"%PDF-1", "x.csv", "unsupported input: pdf"), (b"\0", None, "name the format explicitly"), (b"\0", "x.q", "extension: x.q")):
        with pytest.raises(ConvertError, match=message):
            registry.convert(raw, path)


def test_damaged_input_never_crashes():
    import random

    random.seed(7)
    seeds = [b"<table><tr><td>x<ul><li>[a](b)</table>", b'{"nbformat":4,"cells":[{"cell_type":"markdown","source":"# a"}]}', b"a;b\n1;2", zipped({"word/document.xml": "<w:document><w:body><w:p/></w:body></w:document>"}), b"1\n00:00:01,000 --> 00:00:02,000\nx"]
    for k in range(400):
        raw = bytearray(random.choice(seeds))
        for _ in range(random.randint(1, 8)):
            raw[random.randrange(len(raw))] = random.randrange(256)
        raw = bytes(raw[: random.randint(1, len(raw))] if k % 4 == 0 else raw)
        for path in (None, "x.csv", "x.html", "x.docx", "x.json", "x.srt", "x.eml", "x.ipynb"):
            try:
                registry.convert(raw, path)
            except ConvertError:
                pass
