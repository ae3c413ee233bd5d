"""Visual-novel folders: chapter scripts as blocks and back, names from a bible, and packs with their catalogs."""

from __future__ import annotations

import json
import posixpath
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.script import LINE_CLASSES
from .blocks import blocks_of

_CLASSES = [(name, regex.compile(pattern)) for name, pattern in LINE_CLASSES]
_PROSE = regex.compile(r"^([ \t]*(?:#{1,6}[ \t]+|(?:[-*+]|\d+[.)])[ \t]+))(.*?)([ \t]*#*[ \t]*)$")
_FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)^(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", re.S | re.M)
_SPEAKER = re.compile(r"\s*<1>.*?</1>\s*", re.S)
_TAGS = re.compile(r"<(?:/\d+|\d+/?)>")


def split_frontmatter(text: str) -> tuple[str, str]:
    """(front matter with its fences, body); a text without a closed front matter is all body."""
    m = _FRONT.match(text)
    return (text[: m.end()], text[m.end() :]) if m else ("", text)


def line_parts(line: str, script: bool = True) -> tuple[str, str, str, str]:
    """(class, prefix, text, suffix) of a line without its end; the parts join to the line."""
    if script:
        for name, pattern in _CLASSES:
            if m := pattern.match(line):
                return (name, m[1], m[2], m[3]) if m.re.groups == 3 and m[2] else (name, line, "", "")
    elif m := _PROSE.match(line):
        return "narration", m[1], m[2], m[3]
    body = line.strip(" \t")
    at = line.find(body) if body else len(line)
    return "narration" if body else "blank", line[:at], body, line[at + len(body) :]


def lines_of(text: str) -> list[tuple[str, str]]:
    return [(m[1], m[2]) for m in re.finditer(r"([^\r\n]*)(\r\n|\n|\r|\Z)", text) if m[0]]


def read_script(text: str, script: bool = True) -> list[tuple[int, str, str]]:
    """(line number, kind, text) of the lines to translate; a spoken line carries its speaker as an inline pair."""
    front, body = split_frontmatter(text)
    out = []
    for n, (line, _) in enumerate(lines_of(body)):
        cls, prefix, words, _ = line_parts(line, script)
        if words.strip():
            out.append((n, "heading" if cls == "heading" else "para", f"<1>{prefix.strip()}</1> {words}" if cls == "line" else words))
    return out


def write_script(text: str, translations: dict[int, str], script: bool = True) -> str:
    """The file with translated lines. A translation that would read as another kind of line leaves the line as it was."""
    front, body = split_frontmatter(text)
    out = [front]
    for n, (line, end) in enumerate(lines_of(body)):
        cls, prefix, words, suffix = line_parts(line, script)
        new = translations.get(n)
        if new is not None and words.strip():
            new = " ".join(_TAGS.sub("", _SPEAKER.sub(" ", new, count=1) if cls == "line" else new).split())
            again = prefix + new + suffix
            if new and (not script or line_parts(again)[0::2] == (cls, new) and line_parts(again)[1] == prefix):
                line = again
        out += (line, end)
    return "".join(out)


def chapter_key(path: str) -> tuple[int, str]:
    """Chapters sort by their first number, then by name."""
    name = posixpath.basename(path)
    m = re.search(r"\d+", name)
    return (int(m[0]) if m else 0, name)


def bible_names(text: str) -> list[str]:
    """Bold names of the bullets under a heading for characters."""
    out, inside = [], False
    for line, _ in lines_of(text):
        if m := re.match(r"#{1,6}\s+(.*)", line):
            inside = bool(re.search(r"characters|likovi", m[1], re.I))
        elif inside and (m := re.match(r"\s*[-*+]\s+\*\*(.+?)\*\*", line)):
            out.append(m[1].strip().rstrip(":"))
    return out


def read_blocks(files: DataFrame) -> DataFrame:
    """(path, line, kind, text, block_id) of chapter files (path, text)."""
    rows = blocks_of(files, ["path"], "text", lambda t: ({"line": n, "kind": k, "text": x} for n, k, x in read_script(t or "")), {"line": "int", "kind": "string", "text": "string"})
    return rows.withColumn("block_id", F.concat_ws("#", "path", F.col("line").cast("string")))


BEAT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "speakerKey", "aliasKey")])
SCENE = T.StructType([T.StructField("id", T.StringType()), T.StructField("placeKey", T.StringType()), T.StructField("beats", T.ArrayType(BEAT))])
PACK = T.StructType([T.StructField("packHash", T.StringType()), T.StructField("chapters", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("scenes", T.ArrayType(SCENE))])))])


def pack_beats(packs: DataFrame) -> DataFrame:
    """(pack_id, ord, chapter, scene, place, beat, type, speaker, alias) of pack templates (pack_id, json), in pack order."""
    p = packs.select("pack_id", F.from_json("json", PACK).alias("p"))
    p = p.select("pack_id", F.posexplode("p.chapters").alias("_c", "c"))
    p = p.select("pack_id", "_c", F.col("c.n").alias("chapter"), F.posexplode("c.scenes").alias("_s", "s"))
    p = p.select("pack_id", "_c", "chapter", "_s", F.col("s.id").alias("scene"), F.col("s.placeKey").alias("place"), F.posexplode("s.beats").alias("_b", "b"))
    return p.select("pack_id", F.struct("_c", "_s", "_b").alias("ord"), "chapter", "scene", "place", F.col("b.id").alias("beat"), F.col("b.type").alias("type"), F.coalesce("b.aliasKey", "b.speakerKey").alias("speaker"), F.col("b.aliasKey").alias("alias"))


def catalog_rows(catalogs: DataFrame) -> DataFrame:
    """(pack_id, lang, key, value) of catalogs (pack_id, lang, json map of key to text)."""
    return catalogs.select("pack_id", "lang", F.explode(F.from_json("json", "map<string,string>")).alias("key", "value"))


def pack_blocks(packs: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(pack_id, ord, beat, speaker, text): beats with their text in the catalog, speakers before it as an inline pair."""
    rows = pack_beats(packs).join(catalog_rows(catalogs).select("pack_id", F.col("key").alias("beat"), "value"), ["pack_id", "beat"])
    return rows.select("pack_id", "ord", "beat", "speaker", F.when(F.col("speaker").isNotNull(), F.concat(F.lit("<1>"), "speaker", F.lit(":</1> "), "value")).otherwise(F.col("value")).alias("text"))


def target_catalog(keys: list[str], source: dict[str, str], translations: dict[str, str]) -> str:
    """The translated catalog as JSON: keys of the pack in its order, then what else the source has."""
    own = {k: _TAGS.sub("", _SPEAKER.sub("", translations[k], count=1)) if k in translations else source[k] for k in keys}
    return json.dumps(own | {k: v for k, v in source.items() if k not in own}, ensure_ascii=False, indent=2) + "\n"


def canonical_json(value) -> str:
    """JSON with sorted keys and no space, for hashes that do not depend on the order of keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def natural_key(name: str) -> list:
    """Names in the order people expect: numbers by value, case aside."""
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


def server_events(body: str) -> list[str]:
    """The data of each event of a server-sent stream, up to its end mark."""
    out = []
    for event in re.split(r"\r?\n\r?\n", body):
        data = "\n".join(line[5:].removeprefix(" ") for line in re.split(r"\r?\n", event) if line.startswith("data:"))
        if data == "[DONE]":
            break
        if data:
            out.append(data)
    return out
