"""Text and Markdown files as a data source: `spark.read.format("loomtext")` and `df.write.format("loomtext")`.

Rows are the pieces of a file: path, start (byte offset), kind, body and raw, the piece as it stands in the file; the raws of a file, in
order of start, are the file. A large file is read in many partitions, cut where a piece ends, so it is never one task. Conditions on path leave
out files, conditions on kind leave out pieces, before they reach Spark (with spark.sql.python.filterPushdown.enabled).

Options of the reader: path (a file or a folder, read with its subfolders), format (md or txt; by extension where it is not given, other files
are left out) and rangeBytes. The writer takes rows of path, start and raw, in any order and partitioning; a file appears whole when all tasks have
written, and not at all if one fails.

The driver holds few files at a time: tasks leave lists of what they wrote beside it, which are merged as they are read, and folders are listed one
by one. Of all files it keeps only names and sizes for the tasks of a read, compressed. Millions of files are better dealt out over folders.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched, groupby

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import markdown

#: Bytes of a file that are one partition, about; bytes copied at a time; bytes that a writing task sorts at a time, and that a row has besides its text.
RANGE_BYTES, COPY_BYTES, HELD_BYTES, ROW_BYTES = 8 << 20, 1 << 20, 32 << 20, 256
#: Tasks of a read at most: where ranges would make more, a task takes several. Ranges that are listed together at most.
MOST_TASKS, MOST_LISTED = 2000, 10_000
#: Threads that put files in place, files that they are given together, lists that are merged at a time, and bytes of each that are read at a time.
AT_A_TIME, TOGETHER, MERGED, LIST_BYTES = 16, 4096, 200, 32 << 10
#: What the names of folders of parts begin with.
ASIDE = ".aside-"
FORMATS = {"md": True, "markdown": True, "txt": False, "text": False}
SCHEMA = "path string, start long, kind string, body string, raw string"

_OPENS = re.compile(rb"[ \t]{0,3}(```|~~~)")
_CLOSES = {b"```": re.compile(rb"[^\S\n]*`{3,}[^\S\n]*$"), b"~~~": re.compile(rb"[^\S\n]*~{3,}[^\S\n]*$")}


class UnknownFormat(ValueError):
    """No format for a file."""


def format_of(path: str, given: str | None = None) -> bool:
    """Whether a file is read as Markdown, by a given format or its extension; UnknownFormat names what there is."""
    name = (given or path.rpartition("/")[2].rpartition(".")[2]).lower()
    if name not in FORMATS:
        raise UnknownFormat(f"{path}: no format {name!r}; there are {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def borders(lines: Iterator[bytes], is_markdown: bool, every: int) -> list[int]:
    """Offsets, `every` bytes or more apart, at which a file may be cut: after a blank line that is in no fenced part. The end is the last."""
    out, at, fence = [0], 0, None
    for line in lines:
        at += len(line)
        text = line.rstrip(b"\r\n")
        if fence:
            fence = None if _CLOSES[fence].match(text) else fence
        elif is_markdown and (m := _OPENS.match(line)):
            fence = m[1]
        elif not text.strip() and line.endswith(b"\n") and at - out[-1] >= every:
            out.append(at)
    if at > out[-1] or at == 0:
        out.append(at)
    return out


def rows_of(data: bytes, start: int, is_markdown: bool) -> Iterator[tuple[int, str, str, str]]:
    """(start, kind, body, raw) of the pieces of a range of a file; a byte order mark is part of the first raw alone."""
    mark = b"\xef\xbb\xbf" if start == 0 and data.startswith(b"\xef\xbb\xbf") else b""
    text, at = data[len(mark) :].decode("utf-8"), start
    lead = mark.decode("utf-8")
    for kind, body, end in markdown.pieces(text, is_markdown):
        raw = lead + body + end
        yield at, kind, body, raw
        at, lead = at + len(raw.encode("utf-8")), ""
    if lead:
        yield at, "raw", "", lead


@dataclass
class Ranges(InputPartition):
    """What one task reads, a range of a large file or small files together, as compressed lists, so that the driver can hold all of them."""

    packed: list

    @property
    def ranges(self) -> Iterator[list]:
        """(path, start, end, is Markdown) of each."""
        for p in self.packed:
            yield from json.loads(zlib.decompress(p))


def _cuts(file, start: int, end: int, is_markdown: bool, every: int) -> list[int]:
    """Offsets at which a range of a file is cut; only one of more than `every` bytes is looked through, line by line."""
    if end - start <= every:
        return [start, end]
    file.seek(start)
    return [start + x for x in borders(_lines(file, COPY_BYTES, end - start), is_markdown, every)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.given, self.every = options["path"], options.get("format"), int(options.get("rangebytes", RANGE_BYTES))
        self.paths: set[str] | None = None
        self.kinds: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = getattr(f, "attribute", None)
            if values is not None and name == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            elif values is not None and name == ("kind",):
                self.kinds = values if self.kinds is None else self.kinds & values
            else:
                yield f

    def _files(self):
        """Files of a folder and then of those below it, of which one is listed at a time."""
        from pyarrow import fs

        system, place = _file_system(self.path)
        info = system.get_file_info(place)
        folders = [place]
        while folders:
            folder = folders.pop()
            found = [info] if info.is_file else sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path)
            folders += (f.path for f in reversed(found) if f.type == fs.FileType.Directory and not f.base_name.startswith(ASIDE))
            for f in found:
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    yield system, f, f.path[len(place) :].lstrip("/") or f.base_name

    def _chosen(self):
        for system, f, name in self._files():
            try:
                is_markdown = format_of(name, self.given)
            except UnknownFormat:
                if name == f.base_name and f.path.endswith(self.path.rpartition("/")[2]):  # named by the user
                    raise
                continue
            if self.paths is None or name in self.paths:
                yield system, f, name, is_markdown

    def partitions(self):
        out, now, held, most = [], [], 0, self.every
        for system, f, name, is_markdown in self._chosen():
            cuts = [0, f.size]
            if f.size > most:  # what a task takes as a whole is cut there
                with system.open_input_file(f.path) as file:
                    cuts = _cuts(file, 0, f.size, is_markdown, most)
            for a, b in zip(cuts, cuts[1:]):
                if now and (held + b - a > most or len(now) == MOST_LISTED):
                    out.append(Ranges([zlib.compress(json.dumps(now).encode())]))
                    now, held = [], 0
                if len(out) >= MOST_TASKS:  # a task reads twice as much, one range after the other
                    out, most = [Ranges([p for x in some for p in x.packed]) for some in batched(out, 2)], 2 * most
                now.append((name, a, b, is_markdown))
                held += b - a
        return [*out, Ranges([zlib.compress(json.dumps(now).encode())])]

    def read(self, part: Ranges):
        system, place = _file_system(self.path)
        is_file = system.get_file_info(place).is_file
        for path, start, end, is_markdown in part.ranges:
            with system.open_input_file(place if is_file else f"{place.rstrip('/')}/{path}") as f:
                cuts = _cuts(f, start, end, is_markdown, self.every)
                for a, b in zip(cuts, cuts[1:]):
                    for at, kind, body, raw in rows_of(f.read_at(b - a, a), a, is_markdown):
                        if self.kinds is None or kind in self.kinds:
                            yield path, at, kind, body, raw


def _lines(stream, block: int, size: int | None = None) -> Iterator[bytes]:
    """Lines of a stream, or of its next bytes, read in blocks."""
    left = b""
    while data := stream.read(block if size is None else min(block, size)):
        size = None if size is None else size - len(data)
        lines = (left + data).split(b"\n")
        left = lines.pop()
        yield from (x + b"\n" for x in lines)
    if left:
        yield left


def _listed(system, place: str) -> Iterator[list]:
    with system.open_input_stream(place) as f:
        yield from map(json.loads, _lines(f, LIST_BYTES))


def _write_list(system, place: str, rows: Iterable) -> str:
    with system.open_output_stream(place, buffer_size=LIST_BYTES) as out:
        for r in rows:
            out.write(json.dumps(r).encode() + b"\n")
    return place


def _merged(system, lists: list) -> Iterator[list]:
    """Rows of sorted lists in order; of each list only a block is held."""
    return heapq.merge(*(_listed(system, x) for x in lists))


def _at_most(most: int, system, folder: str, lists: list) -> list:
    """So many sorted lists with the rows of all."""
    while len(lists) > most:
        some, lists = lists[:MERGED], lists[MERGED:]
        lists.append(_write_list(system, f"{folder}/list-{uuid.uuid4().hex}", _merged(system, some)))
    return lists


def _each(pool: ThreadPoolExecutor, f: Callable, items: list | tuple) -> list:
    """f of each item, in threads, of which each takes its share in one go."""
    return [x for own in pool.map(lambda n: [f(i) for i in items[n::AT_A_TIME]], range(AT_A_TIME)) for x in own]


@dataclass
class Parts(WriterCommitMessage):
    """Where the sorted list is of what a task wrote: (path, first start, place of the part) of each run of rows of one file."""

    lists: list


class Writer(DataSourceWriter):
    """Tasks write parts aside, of rows sorted in blocks, one for each run of a file; commit puts the parts of each file together."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.aside, self.overwrite = options["path"], f"{ASIDE}{uuid.uuid4().hex}", overwrite

    def write(self, rows) -> Parts:
        system, place = _file_system(self.path)
        own = f"{place.rstrip('/')}/{self.aside}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        lists: list = []
        held, size = [], 0
        for r in rows:
            held.append((r["path"], r["start"], (r["raw"] or "").encode("utf-8")))
            size += len(held[-1][2]) + ROW_BYTES
            if size > HELD_BYTES:
                lists.append(self._parts(system, own, held))
                held, size = [], 0
        if held:
            lists.append(self._parts(system, own, held))
        return Parts(_at_most(1, system, own, lists))

    @staticmethod
    def _parts(system, own: str, held: list) -> str:
        """Writes rows as a part for each run of one file without a gap; gives the list of the parts."""
        out, f, now, end = [], None, None, -1
        for path, start, data in sorted(held, key=lambda r: r[:2]):
            if f is None or path != now or start != end:
                if f:
                    f.close()
                part = f"{own}/{uuid.uuid4().hex}"
                f, now = system.open_output_stream(part), path
                out.append((path, start, part))
            f.write(data)
            end = start + len(data)
        if f:
            f.close()
        return _write_list(system, f"{own}/list-{uuid.uuid4().hex}", out)

    def commit(self, messages) -> None:
        system, place = _file_system(self.path)
        root = place.rstrip("/")
        aside = f"{root}/{self.aside}"
        lists = _at_most(MERGED, system, aside, [x for m in messages if m for x in m.lists])

        def whole(file: tuple[str, list]) -> tuple[str, str]:
            path, parts = file
            if len(parts) == 1:  # a part that is the file is not copied
                return parts[0], path
            with system.open_output_stream(f"{parts[0]}-whole") as out:
                for part in parts:
                    with system.open_input_stream(part) as f:
                        while block := f.read(COPY_BYTES):
                            out.write(block)
            return f"{parts[0]}-whole", path

        if lists:
            with ThreadPoolExecutor(AT_A_TIME) as pool:
                files = ((path, [part for _, _, part in parts]) for path, parts in groupby(_merged(system, lists), key=lambda r: r[0]))
                done = _write_list(system, f"{aside}/whole", (x for some in batched(files, TOGETHER) for x in _each(pool, whole, some)))
                for some in batched(_listed(system, done), TOGETHER):  # when all are whole
                    _each(pool, lambda folder: system.create_dir(folder, recursive=True), list({f"{root}/{path}".rpartition("/")[0] for _, path in some}))
                    _each(pool, lambda x: system.move(x[0], f"{root}/{x[1]}"), some)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = _file_system(self.path)
        aside = f"{place.rstrip('/')}/{self.aside}"
        from pyarrow import fs

        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomtext"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with conditions handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextFiles)
