"""EPUB files: reading into blocks, writing translations in place, and new books from blocks."""

from __future__ import annotations

import hashlib
import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup as M
from .blocks import TAGS, blocks_of, bounded_batches

_DC = "{http://purl.org/dc/elements/1.1/}"
_XHTML = "http://www.w3.org/1999/xhtml"
COLUMNS = {"sec_ord": "int", "section": "string", "blk_ord": "int", "block_id": "string", "kind": "string", "text": "string", "tags": TAGS}


def _local(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if M.name_of(e) == name]


def _tree(data: bytes) -> ET.Element:
    """A document's tree; what is not strict XML (entities without a declaration, open elements) is read as HTML. Every document keeps its
    place, as block ids count them, so one that holds nothing is an empty tree."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return M.parse_html(data.decode("utf-8-sig", "replace"))


class Book:
    """An EPUB's package document and its text documents in reading order: spine, then navigation, then NCX."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        container = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf_path = _local(container, "rootfile")[0].get("full-path")
        self.opf = ET.fromstring(self.zip.read(self.opf_path))
        folder = posixpath.dirname(self.opf_path)
        items = {e.get("id"): e for e in _local(self.opf, "item")}
        place = lambda e: posixpath.normpath(posixpath.join(folder, unquote(e.get("href", ""))))
        order = [items[r.get("idref")] for r in _local(self.opf, "itemref") if r.get("idref") in items]
        nav = [e for e in items.values() if "nav" in (e.get("properties") or "").split()]
        ncx = [e for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"]
        self.documents: list[tuple[str, str, ET.Element]] = []
        for e in order + nav + ncx:
            path = place(e)
            if path in names and path not in [p for p, _, _ in self.documents]:
                kind = "ncx" if e in ncx else "nav" if e in nav else "text"
                self.documents.append((path, kind, _tree(self.zip.read(path))))

    def meta(self) -> list[tuple[str, ET.Element]]:
        found = [(i, next(iter(self.opf.iter(f"{_DC}{tag}")), None)) for i, tag in (("m.1", "title"), ("m.2", "description"))]
        return [(i, e) for i, e in found if e is not None and (e.text or "").strip()]

    def blocks(self) -> list[tuple[int, str | None, str, M.Found | ET.Element]]:
        """(section, section title, block id, what holds the text) in order; section 0 is the title and description."""
        out: list = [(0, None, i, e) for i, e in self.meta()]
        for n, (_, kind, root) in enumerate(self.documents, 1):
            if kind == "ncx":
                labels = [e for e in _local(root, "text") if (e.text or "").strip()]
                out += [(n, None, f"d{n}.{k}", e) for k, e in enumerate(labels, 1)]
                continue
            body = next(iter(_local(root, "body")), None)
            found = M.find_blocks(body, kind == "nav") if body is not None else []
            title = next(iter(_local(root, "title")), None)
            heading = next((f.text for f in found if f.kind == "heading"), (title.text if title is not None else None))
            if title is not None and (title.text or "").strip():
                out.append((n, heading, f"d{n}.t", title))
            out += [(n, heading, f"d{n}.{k}", f) for k, f in enumerate(found, 1)]
        return out


def read(data: bytes) -> list[dict]:
    rows = []
    for section, title, block_id, held in Book(data).blocks():
        if isinstance(held, M.Found):
            rows.append({"kind": held.kind, "text": held.text, "tags": M.tag_list(held)})
        else:
            rows.append({"kind": "meta" if section == 0 else "heading" if block_id.endswith(".t") else "toc", "text": " ".join(held.text.split()), "tags": []})
        rows[-1] |= {"sec_ord": section, "section": title, "blk_ord": len(rows), "block_id": block_id}
    return rows


def write(data: bytes, translations: dict[str, str], language: str | None = None) -> bytes:
    """The same book with translated blocks; every other entry as it was, the mimetype first and not compressed."""
    book = Book(data)
    for _, _, block_id, held in book.blocks():
        if block_id in translations:
            if isinstance(held, M.Found):
                M.apply(held, translations[block_id])
            else:
                held.text = translations[block_id]
    if language:
        for e in book.opf.iter(f"{_DC}language"):
            e.text = language
        for _, kind, root in book.documents:
            if kind != "ncx":
                root.set("lang", language)
                root.set("{http://www.w3.org/XML/1998/namespace}lang", language)
    ET.register_namespace("", _XHTML)
    changed = {path: ET.tostring(root, encoding="utf-8", xml_declaration=True) for path, _, root in book.documents}
    changed[book.opf_path] = ET.tostring(book.opf, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for info in sorted(book.zip.infolist(), key=lambda i: i.filename != "mimetype"):
            z.writestr(info, changed.get(info.filename, book.zip.read(info.filename)), compress_type=zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def build(title: str, chapters: list[tuple[str, list[tuple[str, str]]]], language: str = "en") -> bytes:
    """A new book of (chapter title, [(kind, text)]); the same input gives the same bytes."""
    from html import escape

    ident = hashlib.sha1("\n".join([title, *(t for t, _ in chapters)]).encode()).hexdigest()
    page = lambda t, body: f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="{_XHTML}" xmlns:epub="http://www.idpf.org/2007/ops" lang="{escape(language)}"><head><title>{escape(t)}</title></head><body>{body}</body></html>'
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'}
    items, spine, links = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'], [], []
    for n, (name, blocks) in enumerate(chapters, 1):
        body = "".join(f"<{'h2' if kind == 'heading' else 'p'}>{escape(text)}</{'h2' if kind == 'heading' else 'p'}>" for kind, text in blocks)
        files[f"EPUB/c{n}.xhtml"] = page(name, body)
        items.append(f'<item id="c{n}" href="c{n}.xhtml" media-type="application/xhtml+xml"/>')
        spine.append(f'<itemref idref="c{n}"/>')
        links.append(f'<li><a href="c{n}.xhtml">{escape(name)}</a></li>')
    files["EPUB/nav.xhtml"] = page(title, f'<nav epub:type="toc"><ol>{"".join(links)}</ol></nav>')
    files["EPUB/package.opf"] = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{ident[:8]}-{ident[8:12]}-{ident[12:16]}-{ident[16:20]}-{ident[20:32]}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata><manifest>{"".join(items)}</manifest><spine>{"".join(spine)}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, compress_type=zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_blocks(files: DataFrame, reader: Callable[[bytes], list[dict]] = read, key: str = "path") -> DataFrame:
    """(key, sec_ord, section, blk_ord, block_id, kind, text, tags) of files with a `content` column, as the binaryFile source gives."""
    return blocks_of(files, [key], "content", reader, COLUMNS)


def write_files(files: DataFrame, translations: DataFrame, writer: Callable[[bytes, dict[str, str]], bytes] = write, key: str = "path") -> DataFrame:
    """(key, content): each file written with its translations (key, block_id, text)."""
    bounded_batches(files.sparkSession)
    by = translations.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("block_id", "text"))).alias("_t"))

    @F.pandas_udf("binary")
    def put(contents: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([writer(bytes(c), dict(t) if t is not None else {}) for c, t in zip(contents, texts)])

    return files.join(by, key, "left").select(key, put("content", "_t").alias("content"))
