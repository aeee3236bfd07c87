"""Rich text: what the reader makes of small files written for these tests."""

import pytest

from quire import engine, registry
from quire.errors import ConvertError


def md(body: str, head: str = "") -> str:
    return registry.convert((r"{\rtf1\ansi\ansicpg1252\deff0{\fonttbl{\f0\fcharset0 Sans;}{\f1\fcharset161 Greek;}}" + head + body + "}").encode("latin-1"))[1]


def test_characters():
    assert md(r"caf\'e9 \f1\'e1\'e2\f0  \u937O\u-10180?\u-9088? a\~b x\_y \{z\}") == "café αβ Ω\U0001f080 a b x‑y {z}\n"
    assert md(r"\uc2\u8364EUR5 \emdash\bullet") == "€R5 —•\n"
    assert md(r"one\line two\par\par three{\v gone}") == "one\\\ntwo\n\nthree\n"
    assert md(r"a{\*\unknown gone}{\info{\title gone}}b{\pict\wmetafile8 \bin4 {{}}}c}") == "abc\n"


def test_styles_and_links():
    head = r"{\stylesheet{\s0 Normal;}{\s1\outlinelevel1 Chapter;}{\s2\sbasedon1 Part;}{\s3 Preformatted Text;}{\s4 Quote;}}"
    assert md(r"\pard\s2\b Top\b0\par\pard plain {\b bold} {\i it}\par", head) == "## Top\n\nplain **bold** *it*\n"
    assert md(r"\pard\s3 x = 1;\par   y\par\pard\s4 said\par more\par\pard end", head) == "```\nx = 1;\n  y\n```\n\n> said\n>\n> more\n\nend\n"
    assert md(r'see {\field{\*\fldinst HYPERLINK "https://a.example/"}{\fldrslt here}} and {\field{\*\fldinst HYPERLINK \\l "m"}{\fldrslt there}}\par{\*\bkmkstart m}{\*\bkmkend m}goal') == 'see [here](https://a.example/) and [there](#m)\n\n<a id="m"></a>goal\n'
    assert md(r"text{\*\footnote \pard note {\b one}} after") == "text[^1] after\n\n[^1]: note **one**\n"


def test_lists():
    head = (
        r"{\*\listtable{\list{\listlevel\levelnfc0\levelstartat3{\leveltext\'02\'00.;}}{\listlevel\levelnfc4\levelstartat1{\leveltext\'02\'01);}}\listid7}"
        r"{\list{\listlevel\levelnfc23\levelstartat1{\leveltext\'01\u8226 ?;}}\listid8}}"
        r"{\*\listoverridetable{\listoverride\listid7\ls1}{\listoverride\listid8\ls2}{\listoverride\listid7{\lfolevel\listoverridestartat\levelstartat9}\ls3}}"
    )
    item = lambda ls, depth, text: rf"\pard{{\listtext x\tab}}\ls{ls}\ilvl{depth} {text}\par"
    body = item(1, 0, "a") + item(1, 1, "b") + item(1, 0, "c") + r"\pard between\par" + item(1, 0, "d") + item(3, 0, "e") + item(2, 0, "f")
    assert md(body, head) == "3. a\n\n   - a) b\n\n4. c\n\nbetween\n\n5. d\n\n9. e\n\n- f\n"


def test_tables():
    rows = r"\trowd\cellx10\cellx20\cellx30 a\cell b\cell c\cell\row\trowd\clmgf\cellx10\clmrg\cellx20\cellx30 d\cell\cell 5\cell\row"
    assert md(rows + r"\pard after") == "| a | b | c |\n| --- | --- | --- |\n| d |  | 5 |\n\nafter\n"
    tall = r"\trowd\clvmgf\cellx10\cellx20 k\cell 1\cell\row\trowd\clvmrg\cellx10\cellx20\cell 2\cell\row"
    assert md(tall) == "|  |  |\n| --- | --- |\n| k | 1 |\n|  | 2 |\n"
    assert md(r"\trowd\cellx10\trhdr\cellx20 7\cell 8\cell\row\trowd\cellx10\cellx20 9\cell 10\cell\row") == "| 7 | 8 |\n| --- | --- |\n| 9 | 10 |\n"


def test_odd_files():
    assert registry.convert(rb"{\rtf1 open {\b bold \par}} more}")[1].startswith("open **bold**")
    assert registry.convert(b"{\\rtf1 " + b"{" * 30_000 + b"deep")[1] == "deep\n"
    assert registry.convert(b"{\\rtf1}")[1] == ""
    assert registry.detect(b"{\\rtf1 x}", "a.txt") == "rtf"
    with pytest.raises(ConvertError, match="malformed"):
        registry.convert(b"words", "a.rtf")


def test_front_ends_of_the_caller(spark):
    shout = registry.FrontEnd("shout", lambda c, e, k: 3 * c.startswith(b"!!"), lambda c, p, a: c[2:].decode().upper() + "\n")
    df = spark.createDataFrame([(1, "!!hey", "a.bin"), (2, "plain", "a.txt"), (3, "plain", "a.bin")], "doc_id long, content string, path string")
    found = {r["doc_id"]: (r["format"], r["markdown"]) for r in engine.to_markdown(df, path="path", extra=[shout]).collect()}
    assert found == {1: ("shout", "HEY\n"), 2: ("text", "plain\n"), 3: (None, None)}
    assert [r["format"] for r in engine.detect(df, path="path", extra=[shout]).orderBy("doc_id").collect()] == ["shout", "text", None]


def test_files_that_differ_in_numbers():
    """Few of them are converted in full, and all become what a full conversion makes of them."""
    import random

    from quire.formats.rtf import Shapes

    draw, full = random.Random(2), []
    bits = [r"\pard\s1 No %s\par ", r"\pard\plain {\b %s}. caf\'e9 \u8211- %s\par ", r"\pard %s\u8211 %s\par ", r"%s{\i  %s} %s\line ", r"\par 1 \tab %s\par ", r"{\info %s}"]
    table = r"\trowd\cellx1000\cellx2000\intbl %s\cell %s\cell\row\trowd\cellx1000\cellx2000 %s\cell %s\cell\row\pard "
    bits += [table, table.replace(r"\intbl %s\cell %s", r"\intbl key\cell customer"), r"{\*\bkmkstart a%s}", r"{\pntext %s}{\pn\pndec} a\par ", r"{\field{\*\fldinst HYPERLINK %s}{\fldrslt x %s}}", r"{\f1\'81 %s} "]
    head = r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset130 B;}}{\stylesheet{\s1\outlinelevel0 heading 1;}}"
    number = lambda: draw.choice(["0", "1", "12", "12", "05", "x", str(draw.randrange(100)), str(draw.randrange(10**9)), "-3", "4.5"])

    def counted(content):
        full.append(content)
        return registry.convert(content)

    shapes, files = Shapes(), []
    for k in range(150):
        one = ([bits[k]] if k < len(bits) else []) + [draw.choice(bits) for _ in range(draw.randint(0, 3))]
        body = "".join(one).replace(r"\fcharset130", r"\fcharset0") + "}"
        files += [((head if k % 2 else head.replace("130", "0")) + body % tuple(number() for _ in range(body.count("%s")))).encode() for _ in range(30)]
    for content in files:
        assert shapes.convert(content, counted) == registry.convert(content), content
    assert len(full) < len(files)
    plain = (head.replace("130", "0") + bits[0] + bits[1] + bits[7] + "}").replace("%s", "%d")
    full.clear()
    for k in range(1000, 3000):
        content = (plain % (k, k + 3, k - 1, k, 9999 - k)).encode()
        assert shapes.convert(content, counted) == registry.convert(content)
    assert len(full) < 20
    assert isinstance(shapes.convert(b"{\\rtf1 " + b"x" * 9000 + b"}", counted)[1], str) and len(full) < 21


def test_orders_share_shapes(spark, tmp_path):
    """The query converts by shapes, on numbers of all lengths."""
    from quire.plans import catalogue

    rows = [(k * 7919 % 10**j, k % 10 ** (j % 5), "OFP"[k % 3]) for k in range(1, 400) for j in range(1, 9)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = catalogue.rtf_to_markdown(spark, str(tmp_path)).collect()
    wanted = sorted((k, f"# Order {k}\n\n**{s}** caf\u00e9 \u2013 {c}\n\n| key | customer |\n| --- | --- |\n| {k} | {c} |\n") for k, c, s in rows)
    assert sorted(map(tuple, out)) == wanted
