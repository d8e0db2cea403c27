"""Export archives as a Spark data source: a partition for each member of a zip, read as a stream.

A member that is a list of conversations is cut into its elements while it is unpacked, so a task holds one conversation and a
batch of rows, whatever the archive's size. Paths may be globs; files are opened through pyarrow's file systems, so a path
with a scheme that these know works as a local one.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "path string, kind string, uuid string, raw string"
SCHEMA = pa.schema([(x.split()[0], pa.string()) for x in MEMBERS.split(", ")])
#: Characters read at once; characters and rows of a batch.
CHUNK, BATCH_CHARS, BATCH_ROWS = 1 << 20, 8_000_000, 1000
CONVERSATIONS = "conversations.json"
OUTSIDE, INSIDE = re.compile(r'["{}\[\],]'), re.compile(r'["\\]')


def elements(read: Callable[[int], str], chunk: int = CHUNK) -> Iterator[str]:
    """The JSON texts of a list's elements, one by one; ``read`` gives the next characters, '' at the end.

    Only brackets, commas and quotes are looked at. A text that is no list, or ends before it should, raises ValueError.
    """
    text = ""
    while not text.strip():
        more = read(chunk)
        if not more:
            raise ValueError("not JSON: it is empty")
        text += more
    text = text.lstrip().removeprefix("﻿").lstrip()
    if not text.startswith("["):
        json.loads(text if len(text) < chunk else '{"x": 0}')  # whole texts that are no JSON say so
        raise ValueError("not a list")
    depth, begin, at, quoted = 1, 1, 1, False
    while depth:
        found = (INSIDE if quoted else OUTSIDE).search(text, at)
        if not found:
            more = read(chunk)
            if not more:
                raise ValueError("not JSON: it ends within its list")
            # what is before the element has been told
            text, at, begin = text[begin:] + more, max(at, len(text)) - begin, 0
            continue
        mark, at = found.group(), found.end()
        if quoted:
            if mark == "\\":
                at += 1
            else:
                quoted = False
        elif mark == '"':
            quoted = True
        elif mark in "{[":
            depth += 1
        elif mark in "}]":
            depth -= 1
        if (mark == "," and depth == 1 and not quoted) or not depth:
            element = text[begin : at - 1].strip()
            if element or mark == ",":
                yield element
            begin = at
    rest = text[begin:]
    while rest or (rest := read(chunk)):
        if rest.strip():
            raise ValueError("not JSON: something follows its list")
        rest = ""


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def decoded(stream: io.BufferedIOBase) -> Callable[[int], str]:
    """A reader of characters of a stream of UTF-8."""
    decoder = codecs.getincrementaldecoder("utf-8")()

    def read(n: int) -> str:
        while True:
            data = stream.read(n)
            text = decoder.decode(data, final=not data)
            if text or not data:
                return text

    return read


def opened(path: str) -> zipfile.ZipFile:
    system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    try:
        return zipfile.ZipFile(system.open_input_file(own))
    except zipfile.BadZipFile as error:
        raise ValueError(f"{path}: a damaged zip ({error})") from None


def archives(path: str) -> list[str]:
    """The files that a path or a glob of its last part names, in order."""
    folder, _, last = path.rpartition("/")
    if not re.search(r"[*?]", last):
        return [path]
    system, own = fs.FileSystem.from_uri(folder) if "://" in path else (fs.LocalFileSystem(), folder or ".")
    wanted = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in last))
    return sorted(f"{folder}/{f.base_name}" if folder else f.base_name for f in system.get_file_info(fs.FileSelector(own)) if wanted.fullmatch(f.base_name))


@dataclass
class Member(InputPartition):
    path: str
    name: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kinds = options["path"], options.get("kinds", "all")

    def partitions(self) -> list[Member]:
        """A partition for each member wanted; only the archives' lists of members are read here."""
        out = []
        for path in archives(self.path):
            with opened(path) as archive:
                names = archive.namelist()
            if not any(n.rpartition("/")[2] == CONVERSATIONS for n in names):
                raise ValueError(f"{path}: no export, since it holds no {CONVERSATIONS} but {', '.join(names[:5]) or 'nothing'}")
            for name in names:
                listed = name.rpartition("/")[2] == CONVERSATIONS
                if name.endswith(".json") and self.kinds in ("all", "conversations" if listed else "files"):
                    out.append(Member(path, name))
        return out

    def rows(self, member: Member) -> Iterator[tuple[str, str, str | None, str]]:
        folder, _, base = member.name.rpartition("/")
        with opened(member.path) as archive, archive.open(member.name) as stream:
            if base != CONVERSATIONS:
                kind, uuid = (folder.rpartition("/")[2], base[:-5]) if folder else (base[:-5], "")
                try:
                    yield member.path, kind, uuid, compact(json.load(stream))
                except ValueError:
                    return  # side files that are no JSON are left out
                return
            try:
                for text in elements(decoded(stream)):
                    value = json.loads(text)
                    yield member.path, "conversation", value.get("uuid") if isinstance(value, dict) else None, compact(value)
            except ValueError as error:
                what = "is not a list of conversations" if str(error) == "not a list" else f"is not JSON ({error})"
                raise ValueError(f"{member.path}: {member.name} {what}") from None

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(member):
            held.append(row)
            size += len(row[3])
            if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=SCHEMA)


class ArchiveSource(DataSource):
    """Format ``export_archive``: (path, kind, uuid, raw) of the zips at ``path``; ``kinds`` is conversations, files or all."""

    @classmethod
    def name(cls) -> str:
        return "export_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, kinds: str = "all") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("export_archive").option("kinds", kinds).load(path)


def write_archives(raw: DataFrame, folder: str) -> DataFrame:
    """Write raw conversations (``raw``) as archives in ``folder``, one for each partition; (path, n) of each.

    A task streams its rows into its archive, and one that runs again writes the same file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path, n = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05}.zip", 0
        system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(own.rpartition("/")[0], recursive=True)
        with system.open_output_stream(own, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(CONVERSATIONS, "w", force_zip64=True) as member:
            member.write(b"[")
            for frame in frames:
                for text in frame["raw"]:
                    member.write((b",\n" if n else b"\n") + text.encode())
                    n += 1
            member.write(b"\n]")
        yield pd.DataFrame({"path": [path], "n": [n]})

    return raw.select("raw").mapInPandas(run, "path string, n long")
