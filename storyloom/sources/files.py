"""Readers and writers of chapter files, plain text, books and containers."""

from __future__ import annotations

import html
import io
import json
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import safe_filename
from storyloom.operators.provenance import CONTROL_FILE, safe_member

CHAPTER = "id string, title string, content string, updated double"
#: Lines that open a chapter.
HEADING = r"(?m)^[ \t　]*(?:#{1,3}[ \t]+\S.*|第[0-9零〇一二三四五六七八九十百千两]+[章回卷节部].{0,40}|(?i:chapter)[ \t]+[0-9ivxlc]+\b.{0,60})[ \t]*$"
#: Bytes of a member of a container in one row; longer ones come in several.
PIECE = 64 << 20
LORE = "title string, kind string, content string"


def chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """Chapters from JSON files {id, title, content, updated}; broken files give rows of nulls."""
    return spark.read.schema(CHAPTER).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def lore(spark: SparkSession, path: str) -> DataFrame:
    """(ref, title, kind, content) of the setting notes under a folder: JSON files {title, kind, content}, and Markdown files, of which the first heading is the title. ref is the file's name without its ending; files that say nothing are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), "value")
    is_json = F.lower("file").endswith(".json")
    parsed = F.from_json("value", LORE)
    title = F.regexp_extract("value", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    text = F.struct(F.nullif(title, F.lit("")).alias("title"), F.lit("").alias("kind"), F.col("value").alias("content"))
    rows = files.where(is_json | F.lower("file").rlike(r"\.(md|markdown|txt)$")).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("ref"), F.when(is_json, parsed).otherwise(text).alias("l"))
    blank = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(""))
    return rows.where((blank("title") != "") | (blank("content") != "")).select("ref", F.when(blank("title") == "", "未命名设定").otherwise(blank("title")).alias("title"), blank("kind").alias("kind"), blank("content").alias("content"))


def split_chapters(text: Column) -> Column:
    """array<struct<title, content>> of a text cut before every heading line; text before the first heading has an empty title."""
    marked = F.regexp_replace(text, f"({HEADING})", "\x01$1")
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    titled = lambda p: p.rlike(r"\A" + HEADING)
    title = lambda p: F.regexp_replace(F.trim(F.regexp_extract(p, r"\A[^\n]*", 0)), r"^#{1,3}\s+", "")
    body = lambda p: F.when(titled(p), F.regexp_replace(p, r"\A[^\n]*\n?", "")).otherwise(p)
    return F.transform(parts, lambda p: F.struct(F.when(titled(p), title(p)).otherwise("").alias("title"), body(p).alias("content")))


def text_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, title, content) of text and Markdown files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(split_chapters(F.col("value"))).alias("idx", "c")).select("path", "idx", "c.title", "c.content")


def _markup(text: str) -> str:
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", "", text)
    text = re.sub(r"(?i)</(p|div|h[1-6]|li|tr)\s*>|<br\s*/?>", "\n", text)
    return html.unescape(re.sub(r"(?s)<[^>]+>", "", text)).strip()


def _epub(data: zipfile.ZipFile) -> list[tuple[str, str]]:
    names = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf"}
    root = ElementTree.fromstring(data.read("META-INF/container.xml")).find(".//c:rootfile", names).get("full-path")
    package = ElementTree.fromstring(data.read(root))
    items = {i.get("id"): i.get("href") for i in package.findall(".//o:item", names)}
    out = []
    for ref in package.findall(".//o:itemref", names):
        name = posixpath.join(posixpath.dirname(root), items.get(ref.get("idref"), ""))
        if name in data.namelist() and safe_member(name):
            page = data.read(name).decode("utf-8", "replace")
            heading = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", page) or re.search(r"(?is)<title>(.*?)</title>", page)
            out.append((_markup(heading[1]) if heading else "", _markup(page)))
    return out


def _docx(data: zipfile.ZipFile) -> list[tuple[str, str]]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    chapters: list[tuple[str, list[str]]] = [("", [])]
    for p in ElementTree.fromstring(data.read("word/document.xml")).iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        if text.strip() and (style is not None and style.get(f"{w}val", "").lower().startswith(("heading", "title")) or re.fullmatch(HEADING, text)):
            chapters.append((text.strip(), []))
        else:
            chapters[-1][1].append(text)
    return [(t, "\n".join(lines).strip()) for t, lines in chapters if t or "".join(lines).strip()]


_STREAM = re.compile(rb"<<(?:[^<>]|<[^<>]*>|<<[^<>]*>>)*>>\s*stream\r?\n")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Td|TD|Tm)\b|T\*|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _pdf_text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    wide = raw[:2] == b"\xfe\xff" or (token[:1] == b"<" and len(raw) % 2 == 0 and len(raw) > 1)
    return raw.decode("utf-16-be", "replace").lstrip("\ufeff") if wide else raw.decode("latin-1")


def _pdf(data: bytes) -> list[tuple[str, str]]:
    """Chapters of the text shown by a PDF's content streams, plain or deflated. Codes are taken as Latin-1 or UTF-16; fonts with codes of their own, pictures and encrypted files give no text."""
    if not data.startswith(b"%PDF-") or b"/Encrypt" in data:
        raise ValueError("not a PDF that can be read")
    lines: list[str] = []
    for m in _STREAM.finditer(data):
        body = data[m.end() : data.find(b"endstream", m.end())]
        if b"/FlateDecode" in m[0]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            now = ""
            for token in _SHOWN.findall(block):
                if token[:1] in b"(<":
                    now += _pdf_text(token)
                elif now:
                    lines.append(now)
                    now = ""
            if now:
                lines.append(now)
    chapters: list[tuple[str, list[str]]] = [("", [])]
    for line in lines:
        if re.fullmatch(HEADING, line):
            chapters.append((line.strip(), []))
        else:
            chapters[-1][1].append(line)
    return [(t, "\n".join(c).strip()) for t, c in chapters if t or "".join(c).strip()]


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, title, content, error) of EPUB, DOCX and PDF files; one that can't be read gives a row with its error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    if content[:5] == b"%PDF-":
                        chapters = _pdf(content)
                    else:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            chapters = _docx(z) if "word/document.xml" in z.namelist() else _epub(z)
                    rows += [(name, i, t, c, None) for i, (t, c) in enumerate(chapters)]
                except (zipfile.BadZipFile, KeyError, AttributeError, ValueError, ElementTree.ParseError) as e:
                    rows.append((name, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "idx", "title", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, idx int, title string, content string, error string")


def container_members(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(container, path, part, content, skipped) of ZIP containers; members longer than `piece` bytes come in parts from 0 on, paths out of the container are listed without content."""

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda name, member, part, data, why: pd.DataFrame({"container": [name], "path": [member], "part": [part], "content": [data], "skipped": [why]})
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not safe_member(m.filename):
                                yield row(name, m.filename, 0, None, "unsafe path")
                                continue
                            with z.open(m) as f:
                                part, data = 0, f.read(piece)
                                while data or part == 0:
                                    yield row(name, m.filename, part, data, None)
                                    part, data = part + 1, f.read(piece)
                except zipfile.BadZipFile:
                    yield row(name, None, 0, None, "not a container")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "container string, path string, part int, content binary, skipped string")


def epub(title: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB of one book's chapters (title, content), which fit the memory of one task."""
    page = lambda t, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(t)}</title></head><body><h1>{html.escape(t)}</h1>{body}</body></html>'
    text = lambda c: "".join(f"<p>{html.escape(line)}</p>" for line in c.splitlines() if line.strip())
    names = [f"c{i:05}" for i in range(len(chapters))]
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    package = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{html.escape(title)}</dc:identifier><dc:title>{html.escape(title)}</dc:title><dc:language>und</dc:language></metadata><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names)}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", package)
        for n, (t, c) in zip(names, chapters):
            z.writestr(f"OEBPS/{n}.xhtml", page(t, text(c)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_container(files: dict[str, bytes], history: list[dict]) -> bytes:
    """A ZIP of the files and their history, one event a line. For one work's metadata, which fits the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            if safe_member(name) and name != CONTROL_FILE:
                z.writestr(name, files[name])
        z.writestr(CONTROL_FILE, "".join(json.dumps(e, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for e in history))
    return out.getvalue()


def markdown_lines(chapters: DataFrame) -> DataFrame:
    """(book_id, idx, value): a chapter (book_id, idx, title, content) as Markdown."""
    return chapters.select("book_id", "idx", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("value"))


def markdown_views(kb: dict[str, DataFrame]) -> DataFrame:
    """(book_id, file, idx, key, n, line): the notes of every book as lines, in order of idx, key and n within a file; written partitioned, never gathered.

    kb: chapters, entities, mentions, events and foreshadowing. Files: source.md (summaries), entities/<name>.md (facts), timeline.md and foreshadowing.md (open ones first).
    """
    s = lambda c: F.coalesce(c, F.lit(""))
    number = F.when(F.col("idx").isNull(), "?").otherwise((F.col("idx") + 1).cast("string"))
    at = kb["chapters"].select(F.col("id").alias("chapter_id"), "idx", F.col("title").alias("chapter_title"))

    def lines(rows: DataFrame, file: Column, key: str, *parts: Column) -> DataFrame:
        cells = F.posexplode(F.filter(F.array(*parts), lambda x: x.isNotNull()))
        return rows.select("book_id", file.alias("file"), F.coalesce("idx", F.lit(-1)).alias("idx"), F.col(key).alias("key"), cells.alias("n", "line"))

    summary = lines(kb["chapters"], F.lit("source.md"), "id", F.concat(F.lit("### "), s("title")), F.lit(""), F.coalesce("summary", F.lit("（无摘要）")), F.lit(""))
    name = F.concat(F.lit("entities/"), safe_filename(F.trim("canonical_name"), F.col("entity_id")), F.lit(".md"))
    entities = kb["entities"].withColumnRenamed("id", "entity_id").withColumn("file", name)
    listed = F.array_join("aliases", "、")
    heads = lines(entities.withColumn("idx", F.lit(-2)), F.col("file"), "entity_id", F.concat(F.lit("# "), s("canonical_name")), F.concat(F.lit("类型："), s("type")), F.lit(""), F.when(s(listed) != "", F.concat(F.lit("别名："), listed)), F.when(s(listed) != "", F.lit("")))
    facts = kb["mentions"].join(entities.select("entity_id", "book_id", "file"), "entity_id").join(at, "chapter_id", "left")
    facts = lines(facts, F.col("file"), "id", F.concat(F.lit("### 第 "), number, F.lit(" 章: "), s("chapter_title")), F.lit(""), F.concat(F.lit("- "), s("fact")), F.when(s("snippet") != "", F.concat(F.lit("  > "), "snippet")), F.lit(""))
    place = F.when(s("where_loc") != "", F.concat(F.lit("（地点："), "where_loc", F.lit("）"))).otherwise("")
    event = F.concat(F.lit("- **第 "), number, F.lit(" 章** ("), s("story_time"), F.lit("): "), s("who"), F.lit(" — "), s("what"), place)
    events = lines(kb["events"].join(at, "chapter_id", "left"), F.lit("timeline.md"), "id", event)
    hints = kb["foreshadowing"].withColumnRenamed("hint_chapter_id", "chapter_id").join(at, "chapter_id", "left").withColumn("key", F.concat(F.when(F.col("status") == "open", "0").otherwise("1"), "id"))
    hint = F.concat(F.lit("- "), s("hint"), F.when(F.col("status") == "open", "").otherwise(F.concat(F.lit(" → "), s("resolution"))), F.lit("（第 "), number, F.lit(" 章）"))
    return reduce(DataFrame.union, [summary, heads, facts, events, lines(hints, F.lit("foreshadowing.md"), "key", hint)])


def usage(tenants: DataFrame, quota: int) -> DataFrame:
    """(tenant, bytes, over) of files (tenant, length), and whether they exceed the quota, so that a write is refused."""
    return tenants.groupBy("tenant").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("over", F.col("bytes") > quota)
