"""Hash-chained history, payload hashes and reading order."""

from __future__ import annotations

import getpass
import hashlib
import json
import posixpath
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from storyloom.functions.text import stripped

CONTROL_FILE = "history.jsonl"
#: Why a container is refused, in the order in which it is looked for.
FAILURES = ("no_manifest", "wrong_format", "unsupported_version", "no_history", "bad_event_hash", "broken_link", "no_author", "files_differ")
#: What a manifest has to say, unless told otherwise.
FORMAT, VERSION = "work", 2


def canonical_json(text: str | None) -> str | None:
    """The same value with sorted keys, no blanks, characters unescaped; null for what is not JSON."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


@pandas_udf(StringType())
def canonical_json_udf(texts):
    return texts.map(canonical_json)


def event_hash(event: dict) -> str:
    """SHA-256 of the canonical form of an event without its own hash."""
    return hashlib.sha256(json.dumps({k: v for k, v in event.items() if k != "event_hash"}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


_LISTED = ArrayType(StructType([StructField("path", StringType()), StructField("sha256", StringType()), StructField("size", LongType())]))


@pandas_udf(StructType([*(StructField(c, StringType()) for c in ("own", "event_hash", "previous_hash", "author")), StructField("files", _LISTED)]))
def _event(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        try:
            e = json.loads(line)
            files = [(f.get("path"), f.get("sha256"), f.get("size")) for f in e.get("changed_files") or []]
            rows.append((event_hash(e), e.get("event_hash"), e.get("previous_event_hash", ""), e.get("author"), files))
        except (TypeError, ValueError, AttributeError):
            rows.append((None, None, None, None, []))
    return pd.DataFrame(rows, columns=["own", "event_hash", "previous_hash", "author", "files"])


def verified(works: DataFrame, history: DataFrame, files: DataFrame, format_name: str = FORMAT, version: int = VERSION) -> DataFrame:
    """(work_id, ok, reason, pos): whether each work's container can be trusted, else the first of FAILURES, with the event it is found in.

    works: (work_id, manifest as JSON text); history: (work_id, pos from 0 without gaps, line as JSON text); files: (work_id, path, sha256, size) of what the container holds now. An event's hash is
    that of its canonical form, it names the hash of the event before (the first none) and an author, and the last one lists the files as they are. A line that
    is no JSON has no right hash. The event before is found by its place, so no history is read in one task; only the last event's file list is compared whole.
    """
    manifest = lambda k: F.get_json_object("manifest", k)
    stated = F.when(F.try_parse_json("manifest").isNull(), 0).when(~manifest("$.format_name").eqNullSafe(F.lit(format_name)), 1).when(~manifest("$.format_version").try_cast("int").eqNullSafe(F.lit(version)), 2)
    events = history.select("work_id", "pos", _event("line").alias("e"))
    before = events.select("work_id", (F.col("pos") + 1).alias("pos"), F.col("e.own").alias("_before"))
    rows = events.join(before, ["work_id", "pos"], "left")
    bad = F.when(F.col("e.own").isNull() | ~F.col("e.event_hash").eqNullSafe(F.col("e.own")), 4).when(F.coalesce("e.previous_hash", F.lit("")) != F.coalesce("_before", F.lit("")), 5).when(stripped(F.coalesce("e.author", F.lit(""))) == "", 6)
    first = rows.withColumn("_r", bad).groupBy("work_id").agg(F.min(F.when(F.col("_r").isNotNull(), F.struct("pos", "_r"))).alias("f"), F.max_by("e.files", "pos").alias("stated"), F.max("pos").alias("last"))
    now = files.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", F.col("size").cast("bigint").alias("size")))).alias("now"))
    joined = works.select("work_id", stated.alias("_m")).join(first, "work_id", "left").join(now, "work_id", "left")
    differ = ~F.coalesce(F.array_sort("stated"), F.array().cast(_LISTED)).eqNullSafe(F.coalesce("now", F.array().cast(_LISTED)))
    reason = F.coalesce("_m", F.when(F.col("last").isNull(), 3), "f._r", F.when(differ, 7))
    pos = F.when(F.col("_m").isNull(), F.coalesce("f.pos", F.when(differ, F.col("last"))))
    return joined.select("work_id", reason.isNull().alias("ok"), F.get(F.array(*map(F.lit, FAILURES)), reason).alias("reason"), F.when(reason > 3, pos).alias("pos"))


@pandas_udf(StringType())
def _event_line(authors: pd.Series, files: pd.Series, previous: pd.Series) -> pd.Series:
    out = []
    for author, listed, before in zip(authors, files, previous):
        e = {"author": author, "changed_files": [{k: (int(f[k]) if k == "size" else f[k]) for k in ("path", "sha256", "size")} for f in listed], "previous_event_hash": before}
        out.append(json.dumps(e | {"event_hash": event_hash(e)}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    return pd.Series(out, dtype=object)


def appended(last: DataFrame, files: DataFrame, author: str) -> DataFrame:
    """(work_id, pos, line): the event to be added to the history of every work of which the files (work_id, path, sha256, size) are not those its last event lists.

    last: (work_id, pos, event_hash, files as an array of (path, sha256, size) in order of path), none for a work without history. A work that has not changed gets no event.
    """
    now = files.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", F.col("size").cast("bigint").alias("size")))).alias("now"))
    both = now.join(last, "work_id", "left").where(~F.col("now").eqNullSafe(F.col("files")))
    return both.select("work_id", (F.coalesce("pos", F.lit(-1)) + 1).alias("pos"), _event_line(F.lit(author), "now", F.coalesce("event_hash", F.lit(""))).alias("line"))


def identity(path: str, user_name: str = "") -> dict[str, str]:
    """The author identity kept in a small JSON file; one is made, with a random client id, where there is none or it is broken. A blank name becomes that of the system user."""
    try:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    except (OSError, ValueError):
        known = {}
    known = known if isinstance(known, dict) else {}
    made = known | {"user_name": user_name.strip() or known.get("user_name") or getpass.getuser(), "client_id": known.get("client_id") or uuid.uuid4().hex}
    if made != known:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(made, f, ensure_ascii=False, sort_keys=True)
    return made


def payload_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of files (path, content); folders, the control file and system leftovers are skipped."""
    kept = ~F.col("path").endswith("/") & (F.col("path") != CONTROL_FILE) & ~F.col("path").startswith("__MACOSX/")
    return files.where(kept).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified between two lists (path, sha256)."""
    b = before.select("path", F.col("sha256").alias("_b"), F.lit(True).alias("_was"))
    a = after.select("path", F.col("sha256").alias("_a"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("modified")
    differs = F.col("_was").isNull() | F.col("_is").isNull() | ~F.col("_b").eqNullSafe(F.col("_a"))
    return b.join(a, "path", "full_outer").where(differs).select("path", change.alias("change"))


def reading_order(stated: DataFrame, chapters: DataFrame) -> DataFrame:
    """(work_id, pos, chapter_id): the stated order (work_id, place, chapter_id) without dangling references, then chapters it leaves out, by book and index.

    Repeated references count where they come first.
    """
    known = stated.join(chapters.select("work_id", F.col("id").alias("chapter_id"), "book_id", "idx").distinct(), ["work_id", "chapter_id"])
    first = known.groupBy("work_id", "chapter_id").agg(F.min("place").alias("place"))
    rows = chapters.select("work_id", F.col("id").alias("chapter_id"), "book_id", "idx").distinct().join(first, ["work_id", "chapter_id"], "left")
    order: list[Column] = [F.col("place").asc_nulls_last(), F.col("book_id"), F.col("idx"), F.col("chapter_id")]
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("work_id").orderBy(*order)) - 1).select("work_id", "pos", "chapter_id")


def safe_member(path: str) -> bool:
    """Whether a path in a container stays inside it."""
    return not path.startswith("/") and ".." not in posixpath.normpath(path).split("/")
