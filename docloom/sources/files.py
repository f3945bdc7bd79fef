"""Plain text and Word files to pages of text, with an error code instead of a lost row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.paragraphs import split_paragraphs

MAX_BYTES, MAX_WORDS, MAX_ENTRIES, MAX_UNPACKED = 10_000_000, 60_000, 2_000, 50_000_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEXT = "path string, kind string, text string, error_code string"


def declared_kind(path: Column) -> Column:
    """txt, docx or pdf by the name's extension, null for others."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("txt", "text"), "txt").when(end.isin("docx", "pdf"), end)


def name_problem(name: Column) -> Column:
    """Why a file name is refused: path, control or too-long; null if it is not."""
    return F.when(name.rlike(r"[/\\]|^\.\.?$"), "path").when(name.rlike(r"[\x00-\x1F\x7F‎‏‪-‮⁦-⁩]"), "control").when(F.length(name) > 255, "too-long")


def safe_name(name: Column, most: int = 120) -> Column:
    """The name that is kept: the last part of a path, single blanks, no control or layout signs, at most so many characters with the extension kept; "document" where nothing is left.

    Composition of letters is left as it is.
    """
    last = F.element_at(F.split(name, r"[/\\\\]"), -1)
    shown = F.regexp_replace(last, r"[\u200B-\u200F\u202A-\u202E\u2060-\u2069\uFEFF\u00AD]", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(shown, r"\s+", " "), r"\p{Cc}", ""))
    end = F.regexp_extract(clean, r"(?i)\.[a-z0-9]{1,10}\z", 0)
    stem = F.substring(clean, F.lit(1), F.least(F.length(clean) - F.length(end), F.lit(most) - F.length(end)))
    short = F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(stem), end))
    return F.when(F.coalesce(clean, F.lit("")) == "", "document").otherwise(short)


def decode(data: bytes) -> str:
    """UTF-16 by its mark, strict UTF-8, else Windows-1252 with its five open places as control characters."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def sniff(data: bytes) -> str:
    """What the bytes are: pdf, docx, zip, encrypted, binary or txt."""
    if b"%PDF-" in data[:1024]:
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        return "docx" if b"word/document.xml" in data else "zip"
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "encrypted"
    return "binary" if b"\0" in data[:65536] and data[:2] not in (b"\xff\xfe", b"\xfe\xff") else "txt"


def docx_text(data: bytes) -> tuple[str | None, str | None]:
    """(text with a blank line between paragraphs, error code). Entries are counted and unpacked under a budget."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > MAX_ENTRIES or sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
                return None, "too-complex"
            with z.open("word/document.xml") as f:
                body = f.read(MAX_UNPACKED + 1)
        if len(body) > MAX_UNPACKED:
            return None, "too-complex"
        root = ElementTree.fromstring(body)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError):
        return None, "unreadable"
    said = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n"}
    return "\n\n".join("".join(said[e.tag](e) for e in p.iter() if e.tag in said) for p in root.iter(f"{WORD}p")), None


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, error_code of each file under path. No row is dropped: a file without text has a code.

    Codes in the order of the checks: empty, too-large, unsupported, mismatch, encrypted, unreadable,
    too-complex, too-many-words, no-text.
    """
    loaded = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # A scan passes over files of no bytes, but the listing has them.
    names = spark.createDataFrame([(re.sub("^([^/:]+:)///", r"\1/", unquote(p)),) for p in loaded.inputFiles()], "path string")
    bare = names.join(loaded.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    files = loaded.select("path", "content").unionByName(bare).select("path", "content", declared_kind(F.col("path")).alias("kind"))

    def one(data: bytes, kind: str | None) -> tuple[str | None, str | None]:
        found = sniff(data)
        for bad, code in ((not data, "empty"), (len(data) > MAX_BYTES, "too-large"), (kind is None or kind == "pdf", "unsupported"), (found == "encrypted", "encrypted"), (found != kind, "mismatch")):
            if bad:
                return None, code
        text, code = docx_text(data) if kind == "docx" else (decode(data), None)
        if code is None:
            n = len(text.split())
            code = "too-many-words" if n > MAX_WORDS else "no-text" if n == 0 else None
        return (text, None) if code is None else (None, code)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(bytes(c), k) for c, k in zip(f.content, f.kind, strict=True)]
            yield pd.DataFrame({"path": f.path, "kind": f.kind, "text": [t for t, _ in made], "error_code": [e for _, e in made]})

    return files.mapInPandas(run, TEXT)


def paragraphs(files: DataFrame) -> DataFrame:
    """path, paragraph_index, page, text of the files that could be read."""
    return split_paragraphs(files.where("error_code IS NULL"), key="path")
