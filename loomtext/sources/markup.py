"""Blocks of XHTML and HTML as text with numbered inline tags, and translated text put back into the tree."""

from __future__ import annotations

import copy
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .blocks import TAGS, blocks_of

# How elements are treated.
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote dt dd td th figcaption caption".split())
CONTAINER = BLOCK | frozenset("div ul ol dl table thead tbody tfoot tr colgroup section article aside nav header footer figure main body address details summary fieldset form hgroup hr".split())
SKIPPED = frozenset("script style pre head template".split())
OPAQUE = frozenset("svg math object audio video canvas script style iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<(/?)(\d+)(/?)>")


def name_of(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2].lower() if isinstance(el.tag, str) else "#comment"


class _Builder(HTMLParser):
    """A tree of a page that may not be well formed: block elements close paragraphs, unknown end tags are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.stack = [self.root]

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if len(top):
            top[-1].tail = (top[-1].tail or "") + text
        else:
            top.text = (top.text or "") + text

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CONTAINER:
            for i in range(len(self.stack) - 1, 0, -1):
                n = self.stack[i].tag
                if n == "p" or n == tag == "li":
                    del self.stack[i:]
                    break
                if n in CONTAINER:
                    break
        el = ET.SubElement(self.stack[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in _VOID:
            self.stack.append(el)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.add(data)


def parse_html(page: str) -> ET.Element:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def content(el: ET.Element) -> list:
    """The strings and elements that el holds, in order."""
    out = [el.text] if el.text else []
    for c in el:
        out.append(c)
        if c.tail:
            out.append(c.tail)
    return out


def put(el: ET.Element, parts: list) -> None:
    for c in list(el):
        el.remove(c)
    el.text = None
    for p in parts:
        if isinstance(p, str):
            if len(el):
                el[-1].tail = (el[-1].tail or "") + p
            else:
                el.text = (el.text or "") + p
        else:
            p.tail = None
            el.append(p)


class Found:
    """A block: its kind, text with numbered tags, the element of each number, the container it stands in and what of that it is."""

    __slots__ = ("kind", "text", "elements", "parent", "parts")

    def __init__(self, kind, text, elements, parent, parts):
        self.kind, self.text, self.elements, self.parent, self.parts = kind, text, elements, parent, parts


# Kinds of blocks by the element that holds them; any other is a paragraph.
KINDS = {f"h{n}": "heading" for n in range(1, 7)} | {"li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "figcaption": "caption", "caption": "caption"}


def _mixed(root: ET.Element) -> set[ET.Element]:
    """root and the containers below which there is another one. Each element is marked once, from the container upwards."""
    above, out = {}, {root}
    for el in root.iter():
        for c in el:
            above[c] = el
            if name_of(c) in CONTAINER:
                up = el
                while up not in out and up is not None:
                    out.add(up)
                    up = above.get(up)
    return out


class _Run:
    """Inline content that is being gathered: text, numbered elements, and the parts of the container it is made of."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.elements: dict[int, ET.Element] = {}
        self.parts: list = []

    def number(self, el: ET.Element) -> int:
        self.elements[len(self.elements) + 1] = el
        return len(self.elements)

    def block(self, holder: ET.Element, nav: bool) -> list[Found]:
        text = re.sub(r"[ \t\r\n\f]+", " ", "".join(self.pieces)).strip()
        kind = "toc" if nav else KINDS.get(name_of(holder), "para")
        return [Found(kind, text, self.elements, holder, self.parts)] if _TAG.sub("", text).strip() else []


def find_blocks(body: ET.Element, nav: bool = False) -> list[Found]:
    """Blocks in document order: the inline content between the borders of containers.

    The tree is gone through once, with the open elements on a list, so any depth will do. Elements within a run become <n>..</n>,
    empty and opaque ones <n/>. Scripts and the like end a run where other containers stand beside them, and are part of it where they do not.
    """
    mixed, out, run = _mixed(body), [], _Run()
    opened: list[tuple] = [(body, iter(content(body)), 0, nav)]  # element, what is left of it, its number or 0 for a container, in navigation
    while opened:
        el, left, number, in_nav = opened[-1]
        part = next(left, None)
        if part is None:
            opened.pop()
            if number:
                run.pieces.append(f"</{number}>")
                continue
            out += run.block(el, in_nav)
            run = _Run()
            continue
        name = name_of(part) if isinstance(part, ET.Element) else ""
        if not number and (name in CONTAINER or (name in SKIPPED and el in mixed)):
            out += run.block(el, in_nav)
            run = _Run()
            if name in CONTAINER:
                opened.append((part, iter(content(part)), 0, in_nav or name == "nav"))
            continue
        if not number:
            run.parts.append(part)
        if isinstance(part, str):
            run.pieces.append(part)
        elif isinstance(part.tag, str):
            n, inside = run.number(part), content(part)
            if not inside or name in OPAQUE:
                run.pieces.append(f"<{n}/>")
            else:
                run.pieces.append(f"<{n}>")
                opened.append((part, iter(inside), n, in_nav))
    return out


def rebuild(text: str, elements: dict[int, ET.Element]) -> list | None:
    """The parts of a translated text with its elements back; null where its tags are not those of the block or do not nest."""
    seen, stack = set(), [(0, [])]
    at = 0
    for m in _TAG.finditer(text):
        if m[1] and m[3]:
            continue
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        n = int(m[2])
        if m[1]:
            number, parts = stack.pop()
            if number != n or not stack:
                return None
            el = ET.Element(elements[n].tag, dict(elements[n].attrib))
            put(el, [p for p in parts if p != ""])
            stack[-1][1].append(el)
            continue
        if n not in elements or n in seen:
            return None
        seen.add(n)
        if m[3]:
            stack[-1][1].append(copy.deepcopy(elements[n]))
        else:
            stack.append((n, []))
    stack[-1][1].append(text[at:])
    return [p for p in stack[0][1] if p != ""] if len(stack) == 1 and seen == set(elements) else None


def apply(found: Found, translation: str) -> None:
    """Puts a translation where the block was; with broken tags, its plain text."""
    parts = rebuild(translation, found.elements)
    if parts is None:
        parts = [_TAG.sub("", translation)]
    whole = content(found.parent)
    first = next((i for i, p in enumerate(whole) if p is found.parts[0] or p == found.parts[0]), 0)
    put(found.parent, whole[:first] + parts + whole[first + len(found.parts) :])


def tag_list(found: Found) -> list[dict]:
    void = set(re.findall(r"<(\d+)/>", found.text))
    return [{"n": n, "kind": "void" if str(n) in void else "pair", "data": json.dumps({"name": name_of(e), "attrs": dict(e.attrib)}, sort_keys=True)} for n, e in found.elements.items()]


COLUMNS = {"blk_ord": "int", "block_id": "string", "kind": "string", "text": "string", "tags": TAGS}


def rows_of(page: str | None) -> Iterator[dict]:
    """A row (COLUMNS) for each block of a page, in order; null is empty."""
    root = parse_html(page or "")
    body = next((e for e in root.iter("body")), root)
    for i, f in enumerate(find_blocks(body), 1):
        yield {"blk_ord": i, "block_id": f"d1.{i}", "kind": f.kind, "text": f.text, "tags": tag_list(f)}


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, blk_ord, block_id, kind, text, tags): the blocks of each page."""
    return blocks_of(pages, [key], html, rows_of, COLUMNS)
