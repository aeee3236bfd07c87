"""The front ends, in the order in which they win ties, and the dispatcher.

A front end scores bytes (3 a strong text signature, 2 a content signature, 1 an extension, 0 no
claim) and converts them to Markdown.  The highest score wins, the first registered on a tie.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from quire.containers.archive import FOREIGN, OLE, PDF, RTF, ZIP, Package, is_zip
from quire.errors import ConvertError, unrecognized, unsupported
from quire.formats import archive, csv, data, html, mail, notebook, rtf, subtitle, svg, text
from quire.functions.strings import decode, extension, lines
from quire.render import to_markdown

Again = Callable[[bytes, str | None], str]


@dataclass(frozen=True)
class FrontEnd:
    id: str
    sniff: Callable[[bytes, str, str | None], int]  # bytes, extension, kind of package
    convert: Callable[[bytes, str | None, Again | None], str]
    refuses: tuple[str, ...] = ()  # foreign content that a lying extension may bring


def _is_svg(content: bytes) -> bool:
    return (b"svg" in content[:8192].lower() or content[:2] == b"\x1f\x8b") and svg.sniffs(content)


def _flat_odf(head: bytes) -> bool:
    return b"office:document" in head and b"urn:oasis:names:tc:opendocument" in head


def _sniff_text(content: bytes, ext: str, kind: str | None) -> int:
    if ext == "txt" and content.startswith(b"\xef\xbb\xbf"):
        try:
            if not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", content[3:].decode("utf-8")):
                return 2
        except UnicodeDecodeError:
            pass
    return int(ext in text.EXTENSIONS)


def _sniff_data(content: bytes, ext: str, kind: str | None) -> int:
    if content.startswith((PDF, ZIP, OLE, RTF)):
        return 0
    if ext in ("json", "jsonl") or (not data.looks_xml(content) and data.opens_json(content)):
        return 2
    return int(ext in data.EXTENSIONS)


def _sniff_subtitle(content: bytes, ext: str, kind: str | None) -> int:
    head = content[:8192]
    if head.startswith((PDF, ZIP, OLE, RTF)):
        return 0
    found = subtitle.kind_of(subtitle.normal(head)) if b"\0" not in head or head[:2] in (b"\xff\xfe", b"\xfe\xff") else "srt"
    return 3 if found == "ass" else 2 if found != "srt" else int(ext in subtitle.EXTENSIONS)


def _sniff_html(content: bytes, ext: str, kind: str | None) -> int:
    head = content[:4096].lower()
    if is_zip(content) or _is_svg(content):
        return 0
    if ext in ("mhtml", "mht") or re.search(rb"(?m)^content-location:", head):
        return 3
    start = head.removeprefix(b"\xef\xbb\xbf").lstrip()
    start = re.sub(rb"\A(?:<\?.*?\?>|<!--.*?-->|\s)+", b"", start, flags=re.S)
    if re.match(rb"<!doctype\s+html|<html[\s>]", start) and not _flat_odf(head):
        return 3
    return 2 if b"http://www.w3.org/1999/xhtml" in head else int(ext in html.EXTENSIONS)


def _convert_html(content: bytes, path: str | None, again: Again | None) -> str:
    head = content[:4096]
    if extension(path) in ("mhtml", "mht") or (re.search(rb"(?im)^content-location:", head) and not head.lstrip().startswith(b"<")):
        message = mail.messages(content)[0]
        leaves = [p for p in message.walk() if not p.is_multipart()]
        pages = [p for p in leaves if p.get_content_type() == "text/html"] or [p for p in leaves if p.get_content_type() == "text/plain"]
        if not pages:
            from quire.errors import malformed

            raise malformed("no text/html or text/plain part")
        parts = {p["content-id"].strip().strip("<>"): (p.get_content_type(), p.get_payload(decode=True) or b"") for p in leaves if p["content-id"]}
        return to_markdown(html.document(mail._text(pages[0]), parts))
    return to_markdown(html.document(html.decode_page(content)))


def _sniff_mail(content: bytes, ext: str, kind: str | None) -> int:
    if content.startswith(OLE):
        return 2 * ("__properties_version1.0".encode("utf-16-le") in content) or int(ext == "msg")
    if content.startswith((PDF, ZIP)):
        return 0
    return 3 if mail.looks_mail(content) else int(ext in mail.EXTENSIONS)


def _by_package(kinds: set[str], extensions: set[str]) -> Callable[[bytes, str, str | None], int]:
    return lambda content, ext, kind: 2 if kind in kinds else int(ext in extensions)


def _document(parse: Callable) -> Callable:
    return lambda content, path, again: to_markdown(parse(content))


@lru_cache(maxsize=1)
def front_ends() -> tuple[FrontEnd, ...]:
    from quire.formats import office

    text_like = ("pdf", "ole", "zip")
    return (
        FrontEnd("csv", lambda c, e, k: int(e in csv.EXTENSIONS), _document(csv.parse), text_like),
        FrontEnd("text", _sniff_text, lambda c, p, a: text.convert(c, p), text_like),
        FrontEnd("data", _sniff_data, lambda c, p, a: data.convert(c, p), (*text_like, "rtf")),
        FrontEnd("subtitle", _sniff_subtitle, _document(subtitle.parse), text_like),
        FrontEnd("html", _sniff_html, _convert_html, text_like),
        FrontEnd("email", _sniff_mail, lambda c, p, a: to_markdown(mail.parse(c, p)), text_like),
        FrontEnd("ipynb", lambda c, e, k: 3 if notebook.sniffs(c) else int(e in notebook.EXTENSIONS), _document(notebook.parse), text_like),
        FrontEnd("svg", lambda c, e, k: 3 if _is_svg(c) else int(e in svg.EXTENSIONS), _document(svg.parse), text_like),
        FrontEnd("docx", _by_package({"docx"}, set("docx docm dotx dotm".split())), _document(office.docx)),
        FrontEnd("rtf", lambda c, e, k: 2 if c.startswith(RTF) else int(e == "rtf"), _document(rtf.parse)),
        FrontEnd("xlsx", _by_package({"xlsx"}, set("xlsx xlsm xltx xltm".split())), _document(office.xlsx)),
        FrontEnd("pptx", _by_package({"pptx"}, set("pptx pptm ppsx ppsm potx potm".split())), _document(office.pptx)),
        FrontEnd("odf", lambda c, e, k: 2 if k in ("odt", "ods", "odp", "odg") or _flat_odf(c[:8192]) else int(e in office.ODF), _document(office.odf)),
        FrontEnd("epub", _by_package({"epub"}, {"epub", "ibooks"}), _document(office.epub)),
        FrontEnd("fb2", lambda c, e, k: 2 if re.search(rb"<FictionBook[\s>]", c[:4096]) else int(e == "fb2"), _document(office.fb2), text_like),
        FrontEnd("zip", lambda c, e, k: (2 if k is None else 0) if is_zip(c) else int(e in archive.EXTENSIONS), lambda c, p, a: archive.convert(c, a)),
    )


def package_kind(content: bytes) -> str | None:
    """Opened once for all front ends that ask."""
    if not is_zip(content):
        return None
    try:
        return Package(content).kind()
    except ConvertError:
        return None


def scores(content: bytes, path: str | None, formats: tuple[str, ...] | None = None, extra: tuple[FrontEnd, ...] = ()) -> list[tuple[str, int]]:
    ext, kind = extension(path), package_kind(content)
    return [(c.id, int(c.sniff(content, ext, kind))) for c in (*front_ends(), *extra) if formats is None or c.id in formats]


def detect(content: bytes, path: str | None, formats: tuple[str, ...] | None = None, extra: tuple[FrontEnd, ...] = ()) -> str | None:
    best = max(scores(content, path, formats, extra), key=lambda s: s[1], default=(None, 0))  # max keeps the first
    return best[0] if best[1] > 0 else None


def convert(content: bytes, path: str | None = None, formats: tuple[str, ...] | None = None, extra: tuple[FrontEnd, ...] = ()) -> tuple[str, str]:
    """(format, Markdown); raises ConvertError.  ``extra`` are a caller's own front ends, tried after these."""
    found = detect(content, path, formats, extra)
    if found is None:
        raise unrecognized(path)
    chosen = next(c for c in (*front_ends(), *extra) if c.id == found)
    for name in chosen.refuses:
        magic = FOREIGN.get(name, RTF)
        if content.removeprefix(b"\xef\xbb\xbf").startswith(magic):
            raise unsupported(name)
    return found, chosen.convert(content, path, lambda inner, name: convert(inner, name, formats, extra)[1])
