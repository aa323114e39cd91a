"""Files as DataFrames: JSON with a fallback, discovery, format detection, EPUB texts, and the sinks."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime
from itertools import chain, count
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """A JSON document or array of the given schema; the fallback (no rows unless given) if the path isn't there."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema) if fallback is None else fallback


def discovered(spark: SparkSession, path: str, extensions: list[str], skip: tuple[str, ...] = ("done", "output", "work")) -> DataFrame:
    """(path, name, length, modificationTime) of the inputs below path: by extension, no lock files, none in the skipped folders; a file in ready/ goes first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")  # the content isn't read
    name = F.element_at(F.split("path", "/"), -1)
    base = path.split("://")[-1].rstrip("/")
    rest = F.substring("path", F.locate(base, "path") + len(base), F.length("path"))
    inside = F.split(rest, "/")
    ok = F.lower(name).rlike("\\.(" + "|".join(extensions) + ")$") & ~name.startswith("~$") & ~F.arrays_overlap(inside, F.array(*(F.lit(s) for s in skip)))
    return found.withColumn("name", name).where(ok).withColumn("queue", F.when(F.array_contains(inside, "ready"), 0).otherwise(1)).orderBy("queue", "name")


def format_of(content: Column, path: Column) -> Column:
    """struct(format, confidence, warning): the signature beats the extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 68))
    all_hex = F.hex(F.substring(content, 1, 4096))
    epub = head.startswith("504B0304") & F.contains(all_hex, F.hex(F.lit("application/epub+zip"))) | (head.startswith("504B0304") & F.contains(F.hex(content), F.hex(F.lit("META-INF/container.xml"))))
    mobi = F.substring(head, 121, 16) == F.hex(F.lit("BOOKMOBI"))
    kfx = head.startswith(F.hex(F.lit("CONT"))) | F.contains(all_hex, F.hex(F.lit("KFX")))
    by_signature = F.when(epub, "epub").when(mobi, F.when(ext == "azw3", "azw3").otherwise("mobi")).when(kfx, "kfx")
    by_extension = F.when(ext.isin("epub", "mobi", "azw3", "kfx"), ext)
    return F.struct(
        F.coalesce(by_signature, by_extension, F.lit("unknown")).alias("format"),
        F.when(by_signature.isNotNull(), "high").when(by_extension.isNotNull(), "extension-only").otherwise("unknown").alias("confidence"),
        F.when(by_signature.isNotNull() & (by_signature != ext), F.concat(F.lit("extension is "), ext)).alias("warning"),
    )


TEXTS = "path string, spine int, href string, xhtml string, drm boolean, error string"


def _spine(content: bytes) -> Iterator[tuple[int, str, str, bool]]:
    """(place, name, text, drm) of a book's documents in reading order."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    locked = "META-INF/encryption.xml" in names
    root = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
    package = list(ElementTree.fromstring(book.read(root)).iter())
    manifest = {e.get("id"): e for e in package if e.tag.endswith("}item")}
    refs = [e.get("idref") for e in package if e.tag.endswith("}itemref")]
    hrefs = [manifest[i].get("href") for i in refs if i in manifest and manifest[i].get("media-type") in ("application/xhtml+xml", "text/html")]
    for place, href in enumerate(hrefs):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(href)))
        if name in names:
            yield place, name, book.read(name).decode("utf-8", "replace"), locked


def epub_texts(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, spine, href, xhtml, drm, error): the documents of each book in reading order.

    A book that can't be read, or only in part, has a last row with nothing but its path and the error; the other books of the task are read.
    A null content is such a book.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                out = []
                try:
                    if content is None:
                        raise ValueError("no content")
                    for row in _spine(content):
                        out.append((path, *row, None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                frame = pd.DataFrame(out, columns=["path", "spine", "href", "xhtml", "drm", "error"])
                yield frame.astype({"spine": "Int32", "drm": "boolean"})

    return files.select("path", "content").mapInPandas(run, TEXTS)


def books(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """epub_texts() of the .epub files below path. Only these are listed, and read one a row; lock files and files of no bytes are none."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.[eE][pP][uU][bB]"} | ({"modifiedAfter": modified_after} if modified_after else {})
    found = spark.read.format("binaryFile").options(**options).load(path)
    return epub_texts(found.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")))


ZIPPED = "path string, content binary"


def zipped(entries: DataFrame) -> DataFrame:
    """entries(path, name, content binary) -> (path, content): a ZIP archive a path, as readers of books ask for it: `mimetype` first and
    stored, the rest deflated in the order of their names. The same entries give the same bytes; of entries with one name the last in the order of their bytes counts.
    An archive is made by one task, as a book is read by one."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        parts = dict(sorted((n, bytes(c)) for n, c in zip(rows["name"], rows["content"], strict=True)))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            for name in sorted(parts, key=lambda n: (n != "mimetype", n)):
                entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                book.writestr(entry, parts[name], zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED, 6)
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [out.getvalue()]})

    return entries.select("path", "name", "content").where("path is not null and name is not null and content is not null").groupBy("path").applyInPandas(one, ZIPPED)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """files(path, content) as files below folder, a path or address that pyarrow knows and executors share; (path, target, size) of what was
    written. A file appears whole: it is written under a name of its own and moved, so a task that runs again leaves the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                target = posixpath.join(base, path.lstrip("/"))
                if posixpath.normpath(target) != target or ".." in path.split("/"):
                    raise ValueError(f"not a path below the folder: {path}")
                system.create_dir(posixpath.dirname(target))
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, target)
                out.append((path, target, len(content)))
            yield pd.DataFrame(out, columns=["path", "target", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, target string, size long")


def moved_to_done(paths: list[str], done: str = "done", now: datetime | None = None) -> dict[str, str]:
    """Inputs moved into the folder `done` beside each; where one of that name is there already, the time is put behind the stem, and a number
    if that is taken too. The new place of each. A path that is gone, as after a run that was cut off, is left out."""
    stamp, out = (now or datetime.now()).strftime("%Y%m%d%H%M%S"), {}
    for path in paths:
        system, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        there = lambda p, s=system: s.get_file_info(p).type != pafs.FileType.NotFound
        if not there(place):
            continue
        folder, name = posixpath.split(place)
        stem, ext = posixpath.splitext(name)
        system.create_dir(posixpath.join(folder, done))
        names = chain([name, f"{stem}_{stamp}{ext}"], (f"{stem}_{stamp}_{k}{ext}" for k in count(2)))
        target = next(t for n in names if not there(t := posixpath.join(folder, done, n)))
        system.move(place, target)
        out[path] = target
    return out


def append_events(events: DataFrame, path: str) -> None:
    """JSON lines, appended; non-ASCII characters as they are."""
    events.write.mode("append").json(path)


def report_json(rows: DataFrame, path: str) -> None:
    """A report with one line-broken JSON object a row, null fields included and non-ASCII characters as they are; a new run replaces it."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def refresh_segments(rows: DataFrame, path: str, job: str = "job") -> None:
    """The segments of the jobs in rows, in full: what a job had before goes, other jobs stay; a run that is repeated leaves the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(path)
