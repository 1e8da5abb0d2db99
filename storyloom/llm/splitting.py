"""Oversized texts in pieces cut at natural boundaries, with overlap.

Every position of a text has a boundary strength. All windows in which a cut may fall
are equally wide, so a sparse table of range maxima needs one level only: the running
maxima over the largest power of two that fits the window, built by doubling in
O(n log window) time and O(n) memory. A window's strongest cut is the larger of two
overlapping entries; strength and position share a number, so ties go to the right.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD, ANYWHERE, NEVER = 6, 5, 4, 3, 2, 1, 0
_SENTENCE = re.compile(r"[。！？!?…｡]+[”’」』）)\"'\]】》]*\s*|\.+[”’)\"'\]]*\s+(?=[\"“‘'(\[]?[^\Wa-z_])")
_CLAUSE = re.compile(r"[，、；：,;:—]+[”’」』）)\"']*\s*")
_BREAK = re.compile(r"\s*[\n\r\x0b\x0c\x85  ]\s*")
_BLANK = re.compile(r" |(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\n\r\x0b\x0c\x85 ]*[\n\r\x0b\x0c\x85 ]")
_SPACE = re.compile(r"\s+")
_CJK = re.compile(r"[⺀-⿿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_STUCK = re.compile(r"(?<=\r)\n|(?<=‍).|[‌‍︀-️\U000e0100-\U000e01ef\U0001f3fb-\U0001f3ff]", re.S)


def strengths(text: str) -> np.ndarray:
    """Of every position 0..len(text), how good a cut before the character there is; the start and the inside of a character sequence are NEVER."""
    out = np.full(len(text) + 1, ANYWHERE, np.int8)
    for m in _CJK.finditer(text):  # between ideographs any place is between words
        out[m.start()] = max(out[m.start()], WORD)
        out[m.end()] = WORD
    for found, strength in ((_SPACE, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in found.finditer(text):
            out[m.start() + 1 : m.end()] = ANYWHERE
            out[m.end()] = max(out[m.end()], strength)
    for m in _BREAK.finditer(text):
        out[m.start() : m.end()] = ANYWHERE
        out[m.end()] = BLANK_LINE if _BLANK.search(m[0]) else LINE
    for m in _STUCK.finditer(text):
        out[m.start()] = NEVER
    if not text.isascii():
        for i, c in enumerate(text):
            if c >= "̀" and unicodedata.combining(c):
                out[i] = NEVER
    out[0] = NEVER
    return out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, advance: int = 1) -> list[tuple[int, int]]:
    """[(start, end)] of the pieces: at most `limit` long, each but the first starting `overlap` before the end of the one before.

    A piece may end anywhere from overlap + advance to limit characters after its start; the strongest
    boundary there is taken, the rightmost of equals. With an advance of 1 a natural boundary is never passed over, but a piece may bring little that is new;
    a greater one bounds the number of pieces to the text's length over advance. A text within the limit is one piece, an empty one none.
    """
    if not 0 <= overlap < limit or not 1 <= advance <= limit - overlap:
        raise ValueError("overlap must be at least 0 and below limit, advance at least 1 and at most what is left")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    best = strengths(text).astype(np.int64) * (n + 1) + np.arange(n + 1)
    span = 1
    while span * 2 <= limit - overlap - advance + 1:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    pieces, start = [], 0
    while n - start > limit:
        low, high = start + overlap + advance, start + limit
        end = int(max(best[low], best[high - span + 1]) % (n + 1))
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)]


def split_pieces(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, advance: int = 1) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, piece) of every row of docs, as cuts() cuts them; positions count code points.

    Null and empty texts give no piece, a text within the limit one. Whitespace is kept as stored, so
    the pieces without their overlaps join to the text. A repeated row is cut again, a null key
    kept, other columns dropped; no rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows, held = [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                for k, (a, b) in enumerate(cuts(t, limit, overlap, advance) if t else ()):
                    rows.append((i, k, a, b, t[a:b]))
                    held += b - a
                if held > 1 << 21:
                    yield _out(keys, rows, key)
                    rows, held = [], 0
            if rows:
                yield _out(keys, rows, key)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, piece_no int, start_pos int, end_pos int, piece string")


def _out(keys: pa.Array, rows: list[tuple], key: str) -> pa.RecordBatch:
    i, k, a, b, t = zip(*rows)
    ints = [pa.array(x, pa.int32()) for x in (k, a, b)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(i)), *ints, pa.array(t, pa.string())], [key, "piece_no", "start_pos", "end_pos", "piece"])


def oversized(pieces: DataFrame, key: str) -> DataFrame:
    """Keys of the texts that came out in more than one piece."""
    return pieces.where("piece_no = 1").select(key).distinct()


def rejoined(pieces: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, hash, fits): SHA-256 of what the pieces of every text (distinct keys) join to without their overlaps, and whether all are within the limit and begin `overlap` before the end of the one before. A text's pieces are gathered in one row, which its text fits too."""
    new = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", overlap + 1, limit))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", new.alias("new"))))
    rows = pieces.groupBy(key).agg(parts.alias("ps"))
    stepped = F.forall(F.sequence(F.lit(0), F.size("ps") - 1), lambda i: (F.get("ps", i)["end_pos"] - F.get("ps", i)["start_pos"] <= limit) & ((i == 0) | (F.get("ps", i)["start_pos"] == F.coalesce(F.get("ps", i - 1)["end_pos"], F.lit(0)) - overlap)))
    return rows.select(key, F.sha2(F.array_join(F.transform("ps", lambda p: p["new"]), ""), 256).alias("hash"), stepped.alias("fits"))
