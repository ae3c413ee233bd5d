"""DOCX files: paragraphs as blocks with tags for formatting, and translations written back into the runs."""

from __future__ import annotations

import copy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

from . import markup as M

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = [r"word/document\.xml", r"word/footnotes\.xml", r"word/endnotes\.xml", r"word/header\d*\.xml", r"word/footer\d*\.xml"]
# What stands around runs without being text of its own; a field, kept as it is; and what says nothing of how text looks.
_INTO = {_W + t for t in ("hyperlink", "ins", "moveTo", "smartTag", "customXml", "sdt", "sdtContent", "bdo", "dir")}
_FIELD = _W + "fldSimple"
_UNSEEN = {_W + t for t in ("lang", "noProof", "lastRenderedPageBreak")}


def parts(z: zipfile.ZipFile) -> list[str]:
    """Body, footnotes, endnotes, headers, footers; numbered parts by number."""
    rank = lambda n: next((i for i, p in enumerate(_PARTS) if re.fullmatch(p, n)), None)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1]) if re.search(r"\d+\.xml$", n) else 0
    return sorted((n for n in z.namelist() if rank(n) is not None), key=lambda n: (rank(n), number(n)))


def _runs(p: ET.Element, link: ET.Element | None = None) -> list[tuple[ET.Element, ET.Element | None]]:
    """The runs and fields of a paragraph in order, with the hyperlink each is in; text that was deleted or moved away is passed over."""
    out = []
    for c in p:
        if c.tag in (_W + "r", _FIELD):
            out.append((c, link))
        elif c.tag in _INTO:
            out += _runs(c, c if c.tag == _W + "hyperlink" else link)
    return out


def _format(run: ET.Element) -> bytes:
    """How a run looks; a field looks like its first run. The language of text is not a matter of looks."""
    own = run.find(f"{_W}r/{_W}rPr" if run.tag == _FIELD else _W + "rPr")
    return b"".join(ET.tostring(c) for c in own if c.tag not in _UNSEEN) if own is not None else b""


class Paragraph:
    """A paragraph's text: the formatting of most of its text is plain, other formatting and links are pairs, tabs and the like void."""

    def __init__(self, p: ET.Element):
        self.p, self.runs = p, _runs(p)
        weight: Counter = Counter()
        for r, _ in self.runs:
            if r.tag != _FIELD:
                weight[_format(r)] += sum(len(t.text or "") for t in r.iter(_W + "t"))
        self.base = max(weight, key=weight.get) if weight else b""
        self.base_run = next((r for r, _ in self.runs if r.tag != _FIELD and _format(r) == self.base), None)
        self.elements: dict[int, ET.Element] = {}
        self.text = self._text()

    def _text(self) -> str:
        out, n, open_link, open_format = [], 0, None, None  # pairs that are open: (number, element or formatting)
        for r, link in [*self.runs, (None, None)]:
            fmt = _format(r) if r is not None else self.base
            if open_format and (open_format[1] != fmt or (open_link[1] if open_link else None) is not link):
                out.append(f"</{open_format[0]}>")
                open_format = None
            if open_link and open_link[1] is not link:
                out.append(f"</{open_link[0]}>")
                open_link = None
            if r is None:
                break
            if link is not None and open_link is None:
                n += 1
                self.elements[n], open_link = link, (n, link)
                out.append(f"<{n}>")
            if fmt != self.base and open_format is None:
                n += 1
                self.elements[n], open_format = r, (n, fmt)
                out.append(f"<{n}>")
            for c in [r] if r.tag == _FIELD else r:
                if c.tag == _W + "t":
                    out.append(c.text or "")
                elif c.tag != _W + "rPr" and c.tag not in _UNSEEN:
                    n += 1
                    self.elements[n] = c
                    out.append(f"<{n}/>")
        return re.sub(r"<(\d+)></\1>", "", "".join(out))

    def kind(self, parents: dict) -> str:
        style = self.p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(_W + "val") or "").lower() if style is not None else ""
        if name.startswith("heading") or name == "title":
            return "heading"
        if name.startswith("caption"):
            return "caption"
        if self.p.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name:
            return "item"
        up = parents.get(self.p)
        while up is not None:
            if up.tag == _W + "tc":
                return "cell"
            up = parents.get(up)
        return "para"

    def write(self, translation: str) -> None:
        """Puts a translation in the place of the runs. What began among them, as a bookmark does, begins before it, what ended ends after it."""
        used = set(map(int, re.findall(r"<(\d+)/?>", self.text)))
        tree = M.rebuild(translation, {n: ET.Element(str(n)) for n in used})
        tree = [re.sub(r"</?\d+/?>", "", translation)] if tree is None else tree
        gone = {_W + "r", _FIELD, *_INTO}
        whole = list(self.p)
        first = next((i for i, c in enumerate(whole) if c.tag in gone), len(whole))
        begun = [c for c in whole[first:] if c.tag.endswith("Start")]
        after = [c for c in whole[first:] if c.tag not in gone and c not in begun]
        for c in whole:
            self.p.remove(c)
        self.p.extend([*whole[:first], *begun])

        def run(fmt_of: ET.Element | None, child: ET.Element) -> ET.Element:
            r = ET.Element(_W + "r")
            fmt = fmt_of.find(_W + "rPr") if fmt_of is not None else None
            if fmt is not None:
                r.append(copy.deepcopy(fmt))
            r.append(child)
            return r

        def emit(parts: list, into: ET.Element, fmt: ET.Element | None) -> None:
            for x in parts:
                if isinstance(x, str):
                    t = ET.Element(_W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = x
                    into.append(run(fmt, t))
                    continue
                own = self.elements[int(x.tag)]
                if own.tag == _FIELD:
                    into.append(copy.deepcopy(own))
                    into[-1].tail = None
                elif own.tag == _W + "hyperlink":
                    link = ET.SubElement(into, own.tag, dict(own.attrib))
                    emit(M.content(x), link, fmt)
                elif own.tag == _W + "r":
                    emit(M.content(x), into, own)
                else:
                    into.append(run(fmt, copy.deepcopy(own)))

        emit(tree, self.p, self.base_run)
        self.p.extend(after)


def _paragraphs(data: bytes):
    z = zipfile.ZipFile(io.BytesIO(data))
    for path in parts(z):
        root = ET.fromstring(z.read(path))
        parents = {c: e for e in root.iter() for c in e}
        own = [Paragraph(p) for p in root.iter(_W + "p")]
        yield path, root, parents, own
    z.close()


def read(data: bytes) -> list[dict]:
    """Blocks of all parts; a section starts at each first-level heading of the body, other parts are a section each."""
    rows, section = [], 0
    for path, _, parents, own in _paragraphs(data):
        part = path.rpartition("/")[2][:-4]
        section += 1
        title = None
        for n, p in enumerate(own, 1):
            if not re.sub(r"</?\d+/?>", "", p.text).strip():
                continue
            style = p.p.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and (style.get(_W + "val") or "").lower().replace(" ", "") == "heading1":
                section += 1
                title = p.text
            rows.append({"sec_ord": section, "section": title, "blk_ord": len(rows) + 1, "block_id": f"{part}-{n}", "kind": p.kind(parents), "text": p.text, "tags": []})
    return rows


def write(data: bytes, translations: dict[str, str]) -> bytes:
    z, changed = zipfile.ZipFile(io.BytesIO(data)), {}
    for path, root, _, own in _paragraphs(data):
        part = path.rpartition("/")[2][:-4]
        for n, p in reversed(list(enumerate(own, 1))):  # inner paragraphs before those that hold them
            if f"{part}-{n}" in translations:
                p.write(translations[f"{part}-{n}"])
        changed[path] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        for info in z.infolist():
            new.writestr(info, changed.get(info.filename, z.read(info.filename)))
    return out.getvalue()
