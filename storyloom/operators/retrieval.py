"""Contexts put together for a reader: outlines, blocks within budgets, and what is shown beside a question, a chapter or an alert.

Parts are rows in order; a text is joined only where a budget bounds it. Books are never gathered: running totals come from prefix.running, and every question, chapter or alert
takes the first rows that can fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.functions.text import chapter_label, shortened
from storyloom.session import written

# Headings and joints of the contexts, and what they are bounded by.
JOINT = "\n\n---\n\n"
TIMELINE, NO_TIMELINE, OPEN_HINTS, NO_HINTS = "## 时间线", "## 时间线\n（暂无事件记录）", "## 未解伏笔", "## 伏笔（open）\n（暂无记录）"
BEFORE, KNOWN, RECALL, FOUND = "# 已入库前情索引", "## 已识别实体", "前情回顾", "检索相关"
TOO_LITTLE = "（知识库数据较少，正在积累中）"
CHAPTER_EVENTS, RULES, SURE_RULES, ORDER = "## 本章已入库事件", "## 已确认/已记录规则", "## 已确认规则", "## 时间线参考"
# End of the fixed values.


def _or(c: str | Column, d: str = "") -> Column:
    return F.coalesce(c, F.lit(d))


def joined(rows: DataFrame, key: list[str], order: list[str], text: str, joint: str) -> DataFrame:
    """(key, text): texts of one key joined in order. For rows that a budget or count bounds."""
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), joint).alias(text))


def first_rows(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key, with their place `pos` from 1."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("pos") <= n)


# ---- renderers


def chapter_block(most: int | Column | None = None) -> Column:
    """A chapter (idx, title, summary) as a block of at most `most` characters."""
    label = F.when(F.col("idx").isNull(), "章节").otherwise(chapter_label(F.col("idx")))
    text = F.concat(F.lit("## "), label, F.lit(": "), _or("title"), F.lit("\n"), _or("summary"))
    return text if most is None else shortened(text, most)


def entity_heads(entities: DataFrame) -> DataFrame:
    """(id, book_id, canonical_name, head): the first lines of an entity's block."""
    aliases = F.array_join("aliases", "、")
    head = F.concat(F.lit("## "), _or("canonical_name"), F.lit(" ("), _or("type"), F.lit(")"), F.when(_or(aliases) != "", F.concat(F.lit("\n别名："), aliases)).otherwise(""), F.lit("\n"))
    return entities.select("id", "book_id", "canonical_name", head.alias("head"))


def entity_blocks(entities: DataFrame, mentions: DataFrame, chapters: DataFrame, most: int) -> DataFrame:
    """(id, book_id, canonical_name, text): every entity with its facts in order of chapter, as many as fit `most` characters one after another; line ends between lines count. A head that does not fit gives no text."""
    heads = entity_heads(entities).where(F.length("head") <= most)
    at = chapters.select(F.col("id").alias("chapter_id"), "idx", F.col("title").alias("chapter_title"))
    label = F.concat(F.lit("### "), chapter_label(F.col("idx")), F.lit(": "), _or("chapter_title"), F.lit("\n- ")).alias("label")
    said = F.concat(_or("fact"), F.when(_or("snippet") != "", F.concat(F.lit("\n  > "), "snippet")).otherwise(""), F.lit("\n"))
    facts = mentions.select("id", "entity_id", "chapter_id", F.length(said).alias("n")).join(heads.select(F.col("id").alias("entity_id"), F.length("head").alias("before")), "entity_id").join(at, "chapter_id", "left")
    facts = facts.select("entity_id", "idx", F.col("id").alias("mention_id"), "before", "n", label)
    sized = running(facts, ["entity_id"], [F.col("idx"), F.col("mention_id")], {"upto": (F.length("label") + F.col("n") + 1).cast("bigint")})
    fit = sized.where(F.col("upto") + F.col("before") <= most).select(F.col("mention_id").alias("id"), F.col("entity_id").alias("_e"), "rank", "label")
    lines = mentions.select("id", said.alias("said")).join(fit, "id").select(F.col("_e").alias("entity_id"), "rank", F.concat("label", "said").alias("line"))  # texts are put in when it is known which fit
    kept = joined(lines, ["entity_id"], ["rank"], "line", "\n").withColumnRenamed("entity_id", "id")
    return heads.join(kept, "id", "left").select("id", "book_id", "canonical_name", F.concat_ws("\n", "head", "line").alias("text"))


def event_line() -> Column:
    """An event (idx, story_time, who, what, where_loc) as a line."""
    place = F.when(_or("where_loc") == "", "").otherwise(F.concat(F.lit("（"), "where_loc", F.lit("）")))
    return F.concat(F.lit("- **"), chapter_label(F.col("idx")), F.lit("** ("), _or("story_time"), F.lit("): "), _or("who"), F.lit(" — "), _or("what"), place)


def hint_line() -> Column:
    return F.concat(F.lit("- "), _or("hint"), F.lit("（"), chapter_label(F.col("idx")), F.lit("）"))


# ---- contexts of books


def context_before(chapters: DataFrame, entities: DataFrame, most: int = 6000, last: int = 8, names: int = 40) -> DataFrame:
    """(book_id, text): the last done chapters with a summary, then the first entities by name, as many as fit; only books with such a chapter."""
    done = chapters.where("status = 'done' AND coalesce(summary, '') <> ''").select("book_id", "id", "idx", chapter_block().alias("text"))
    recent = first_rows(done, ["book_id"], [F.desc("idx"), F.desc("id")], last)
    order = Window.partitionBy("book_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    fit = recent.withColumn("upto", len(BEFORE) + F.sum(F.length("text")).over(order)).where(F.col("upto") <= most)
    books = recent.groupBy("book_id").agg(F.lit(len(BEFORE)).alias("_least")).join(fit.groupBy("book_id").agg(F.max("upto").alias("_used")), "book_id", "left").select("book_id", F.coalesce("_used", "_least").alias("used"))
    items = first_rows(entities.select("book_id", "id", "canonical_name", F.concat(F.lit("- "), _or("canonical_name"), F.lit("（"), _or("type"), F.lit("）")).alias("text")), ["book_id"], [F.col("canonical_name"), F.col("id")], names)
    over = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    room = items.join(books.where(F.col("used") < most), "book_id").withColumn("upto", F.col("used") + len(KNOWN) + F.sum(F.length("text")).over(over)).where(F.col("upto") <= most)
    heading = items.select("book_id").distinct().join(books.where(F.col("used") < most), "book_id").select("book_id", F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit(KNOWN).alias("text"))
    lines = [
        books.select("book_id", F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(BEFORE + "\n").alias("text")),
        fit.select("book_id", F.lit(1).alias("part"), (-F.col("pos")).alias("n"), F.concat("text", F.lit("\n")).alias("text")),
        heading, room.select("book_id", F.lit(3).alias("part"), F.col("pos").alias("n"), "text"),
    ]
    return joined(reduce(DataFrame.union, lines), ["book_id"], ["part", "n"], "text", "\n").select("book_id", F.left("text", F.lit(most)).alias("text"))


def prediction_lines(chapters: DataFrame, hints: DataFrame, last: int = 6, most: int = 20) -> DataFrame:
    """(book_id, part, pos, line): the notes of the last chapters, each cut to 800 characters, and the first open hints (with idx)."""
    done = chapters.where("status = 'done' AND coalesce(summary, '') <> ''")
    notes = first_rows(done, ["book_id"], [F.desc("idx"), F.desc("id")], last).withColumn("pos", F.count("*").over(Window.partitionBy("book_id")) - F.col("pos") + 1)
    note = F.concat(F.lit("第 "), (_or0("idx") + 1).cast("string"), F.lit(" 章《"), _or("title"), F.lit("》："), F.left("summary", F.lit(800)))
    open_ = first_rows(hints.where("status = 'open'"), ["book_id"], [F.col("idx"), F.col("id")], most)
    line = F.concat(F.lit("- 第 "), (_or0("idx") + 1).cast("string"), F.lit(" 章："), _or("hint"))
    return notes.select("book_id", F.lit("note").alias("part"), F.col("pos").cast("int").alias("pos"), note.alias("line")).union(open_.select("book_id", F.lit("hint"), "pos", line))


def _or0(c: str) -> Column:
    return F.coalesce(c, F.lit(0))


# ---- question contexts


def question_contexts(kb: dict[str, DataFrame], questions: DataFrame, named: DataFrame, hits: DataFrame, caps: Column, chapter_cap: Column) -> DataFrame:
    """(question_id, pos, kind, ref_id, text): what is put beside every question, in order, cut to its budget.

    kb: chapters, entity blocks (entity_blocks() at the greatest cap, with `blocks`), events and hints with idx, names in events; questions: (question_id, book_id, text, budget, timeline, hints), the last
    two telling what it asks for; named: (question_id, entity_id, canonical_name) called by name; hits: (question_id, kind, ref_id) found by vectors or stated, kind chapter or entity. caps and
    chapter_cap: most characters of an entity's and a chapter's block, of the question's columns.

    The timeline (first 50 events, of those named if any is named) and open hints come first if asked for. Chapters follow, those hit before the rest, then entities likewise; each is cut to its cap and what is left.
    A question meets only the first blocks of its book that could fit its budget beside those hit.
    """
    q = questions.select("question_id", "book_id", F.col("budget").cast("bigint").alias("budget"), "timeline", "hints", caps.alias("entity_cap"), chapter_cap.alias("chapter_cap"))
    # timeline and hints: places and sizes first
    places = running(kb["events"].select("book_id", "id", "idx", "created_at", F.length(event_line()).alias("n")), ["book_id"], [F.col("idx"), F.col("created_at"), F.col("id")], {}, "place").select("book_id", "id", "place", "n")
    few = named.groupBy("question_id").agg(F.lit(True).alias("_named"))
    asked = q.where("timeline").select("question_id", "book_id").join(few, "question_id", "left")
    every = asked.where("_named IS NULL").join(places.where("place <= 50"), "book_id").select("question_id", "book_id", "place", "n")
    firsts = first_rows(kb["names_in_events"].join(places.select("id", "place", "n"), "id"), ["book_id", "canonical_name"], [F.col("place")], 50).drop("pos", "id")  # the first 50 of several names are among the first 50 of each
    own = asked.where("_named").select("question_id", "book_id").join(named.select("question_id", "canonical_name").distinct(), "question_id").join(firsts, ["book_id", "canonical_name"]).select("question_id", "book_id", "place", "n").distinct()
    told = written(first_rows(every.unionByName(own), ["question_id"], [F.col("place")], 50), "told")
    told_size = told.groupBy("question_id").agg((F.sum("n") + F.count("*") - 1).alias("_told"))
    open_ = running(kb["hints"].where("status = 'open'").select("book_id", "id", "idx", hint_line().alias("line")), ["book_id"], [F.col("idx"), F.col("id")], {"upto": (F.length("line") + 1).cast("bigint")})
    most = q.where("hints").groupBy("book_id").agg(F.max("budget").alias("_most"))
    listed = open_.join(most, "book_id").where("upto <= _most").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rank", "upto", "line"))).alias("_hints"))  # hints past the budget are cut anyway
    listed = written(listed, "hints")
    planted = F.filter("_hints", lambda x: x["upto"] <= F.col("budget"))
    hinted = q.where("hints").join(listed, "book_id", "left").select("question_id", F.when(F.coalesce(F.size(planted), F.lit(0)) < 1, NO_HINTS).otherwise(F.concat(F.lit(OPEN_HINTS + "\n"), F.array_join(F.transform(planted, lambda x: x["line"]), "\n"))).alias("text"))
    # hits of a question
    found = hits.union(named.select("question_id", F.lit("entity"), F.col("entity_id"))).distinct()
    found = found.select("question_id", F.when(F.col("kind") == "chapter", 2).otherwise(3).alias("part"), F.col("ref_id").alias("id"))
    own_hits = found.groupBy("question_id").agg(F.collect_list(F.struct("part", "id")).alias("hits"))
    used = F.when(F.col("timeline"), F.when(F.col("_told").isNull(), len(NO_TIMELINE)).otherwise(F.col("_told") + len(TIMELINE) + 1)).otherwise(0) + F.coalesce("_hinted", F.lit(0))
    left = q.join(told_size, "question_id", "left").join(hinted.select("question_id", F.length("text").alias("_hinted")), "question_id", "left").withColumn("left", F.col("budget") - used).where("left > 0").join(own_hits, "question_id", "left")
    heads_before = F.col("timeline").cast("int") + F.col("hints").cast("int")
    some = left.select("question_id", "book_id", "left", "entity_cap", "chapter_cap", "hits", heads_before.alias("heads"), (F.col("left") + F.coalesce(F.size("hits"), F.lit(0)) * 400).alias("reach"))
    some = written(some, "asking")
    # blocks: those hit, and of the rest as many from the beginning as could fit
    chapters = kb["chapters"].where("status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL").select("book_id", "id", F.coalesce("idx", F.lit(-1)).alias("i"), chapter_block().alias("text"))
    blocks = chapters.select("book_id", "id", F.lit(2).alias("part"), F.lit("").alias("name"), "i", "text").unionByName(kb["blocks"].where("book_id IS NOT NULL").select("book_id", "id", F.lit(3).alias("part"), F.col("canonical_name").alias("name"), F.lit(0).alias("i"), "text"))
    blocks = written(blocks, "blocks")  # texts are put in when it is known which are shown
    least = F.least("size", F.lit(400)).cast("bigint")  # a block takes at least so much, whatever it is cut to
    sized = running(blocks.select("book_id", "id", "part", "name", "i", F.length("text").alias("size")), ["book_id", "part"], [F.col("name"), F.col("i"), F.col("id")], {"upto": least}).select("book_id", "part", "rank", "id", "size", (F.col("upto") - least).alias("before"))
    cut = F.when(F.col("part") == 2, F.col("chapter_cap")).otherwise(F.col("entity_cap")).alias("cap")
    columns = ["question_id", "part", "rank", "id", "size", "left", cut, "heads"]
    furthest = some.groupBy("book_id").agg(F.max("reach").alias("_reach"))
    near = some.join(sized.join(furthest, "book_id").where("before < _reach").drop("_reach"), "book_id").where("before < reach")
    near = near.select(*columns, F.coalesce(F.array_contains("hits", F.struct("part", "id")), F.lit(False)).alias("hit"))
    far = some.select("*", F.explode("hits").alias("h")).select("*", F.col("h.part").alias("part"), F.col("h.id").alias("id")).join(sized, ["book_id", "part", "id"]).where("before >= reach").select(*columns, F.lit(True).alias("hit"))
    capped = F.least("size", "cap").cast("bigint")
    over = Window.partitionBy("question_id").orderBy("part", F.when(F.col("hit"), 0).otherwise(1), "rank")
    upto = F.sum(capped).over(over.rowsBetween(Window.unboundedPreceding, 0))
    rows = near.unionByName(far).withColumns({"upto": upto, "_o": F.row_number().over(over), "capped": capped}).withColumn("kept", F.least("upto", "left") - F.least(F.col("upto") - F.col("capped"), "left")).where("kept > 0")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("_o")) + F.col("heads")
    rows = written(rows.select("question_id", place.alias("pos"), "part", "id", "kept"), "shown")
    # texts, each where its row is put out
    shown = rows.join(blocks.select("part", "id", "text"), ["part", "id"]).select("question_id", "pos", F.when(F.col("part") == 2, "chapter").otherwise("entity").alias("kind"), F.col("id").alias("ref_id"), _cut(F.col("text"), F.col("kept")).alias("text"))
    lines = told.join(kb["events"].select("id", event_line().alias("line")).join(places.select("book_id", "id", "place"), "id"), ["book_id", "place"])
    timeline = q.where("timeline").select("question_id").join(joined(lines.select("question_id", "pos", "line"), ["question_id"], ["pos"], "line", "\n"), "question_id", "left")
    none = F.lit(None).cast("string").alias("ref_id")
    timeline = timeline.select("question_id", F.lit(1).alias("pos"), F.lit("timeline").alias("kind"), none, F.when(F.col("line").isNull(), NO_TIMELINE).otherwise(F.concat(F.lit(TIMELINE + "\n"), "line")).alias("text"))
    hinted = hinted.join(q.select("question_id", "timeline"), "question_id").select("question_id", (F.col("timeline").cast("int") + 1).alias("pos"), F.lit("hints").alias("kind"), none, "text")
    return timeline.unionByName(hinted).unionByName(shown)


def _cut(text: Column, most: Column) -> Column:
    """At most `most` characters, the last three of a cut text being dots."""
    dots = F.concat(F.substring(text, F.lit(1), F.greatest(most - 3, F.lit(0)).cast("int")), F.substring(F.lit("..."), F.lit(1), F.least(most, F.lit(3)).cast("int")))
    return F.when(F.length(text) > most, dots).otherwise(text)


# ---- reading contexts


def reading_contexts(chapters: DataFrame, readers: DataFrame, hits: DataFrame, most: int = 14_000) -> DataFrame:
    """(reader_id, text): what is shown before a chapter is read.

    readers: (reader_id, book_id); hits: (reader_id, rank, source_type, source_id, document). The last three done chapters of the book with a summary are recalled, as many as fit one after another; if over 200 characters
    are left, up to 12 hits of different sources follow, each cut to 300 characters, if they fit together. Readers of whose book nothing is known get ''.
    """
    done = chapters.where("status = 'done' AND coalesce(summary, '') <> '' AND book_id IS NOT NULL")
    label = F.when(F.col("idx").isNull(), "章节").otherwise(chapter_label(F.col("idx")))
    body = F.concat(F.lit(f"## {RECALL}\n"), label, F.lit(": "), _or("title"), F.lit("\n"), "summary", F.lit("\n"))
    recent = first_rows(done.select("book_id", "id", "idx", body.alias("text")), ["book_id"], [F.desc("idx"), F.desc("id")], 3)
    over = Window.partitionBy("book_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    fit = recent.withColumn("upto", F.sum(F.length("text")).over(over)).where(F.col("upto") <= most)
    anchor = joined(fit.withColumn("n", -F.col("pos")), ["book_id"], ["n"], "text", "\n").join(fit.groupBy("book_id").agg(F.max("upto").alias("used")), "book_id")
    once = hits.groupBy("reader_id", "source_type", "source_id").agg(F.min(F.struct("rank", "document")).alias("h"))
    line = F.concat(F.lit("- ["), "source_type", F.lit("] "), F.when(F.length("h.document") > 300, F.concat(F.left("h.document", F.lit(300)), F.lit("…"))).otherwise(F.col("h.document")))
    found = joined(first_rows(once.select("reader_id", F.col("h.rank").alias("rank"), "source_type", "source_id", line.alias("line")), ["reader_id"], [F.col("rank"), F.col("source_type"), F.col("source_id")], 12), ["reader_id"], ["pos"], "line", "\n")
    block = F.concat(F.lit(f"## {FOUND}\n"), "line", F.lit("\n"))
    rows = readers.join(anchor, "book_id", "left").join(found, "reader_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    fits = (most - F.col("used") > 200) & (F.col("used") + F.length(block) <= most)
    return rows.select("reader_id", F.left(F.concat_ws("\n", "text", F.when(fits, block)), F.lit(most)).alias("text"))


# ---- consistency


def rule_lines(rules: DataFrame, most: int, cut: int) -> DataFrame:
    """(book_id, pos, line): the first rules of a book by name."""
    rows = first_rows(rules.where("book_id IS NOT NULL"), ["book_id"], [F.col("name"), F.col("id")], most)
    return rows.select("book_id", "pos", F.concat(F.lit("- "), _or("name"), F.lit(": "), F.left(_or("body"), F.lit(cut))).alias("line"))


def focused_events(laid: DataFrame, focus: DataFrame, key: str, segments: int, each: int, most: int) -> DataFrame:
    """(key, pos, id): the events of a zoomed timeline shown for every focus (key, book_id, chapter_id): of its first segments the first events, `most` in all.

    laid: events with their layout. Shown are those of importance 3 or more and those of the focus chapter. A focus meets the first events of each
    of its book's segments and its own chapter's events, not the whole book.
    """
    events = laid.select("book_id", "id", "chapter_id", "segment_id", "lane", "story_order", "idx", "importance")
    order = [F.col("story_order"), F.col("idx"), F.col("id")]
    base = first_rows(events.where("importance >= 3"), ["book_id", "segment_id"], order, each).drop("pos")
    shown = focus.select(key, "book_id").join(base, "book_id").select(key, *events.columns)
    own = focus.where("chapter_id IS NOT NULL").select(key, "book_id", "chapter_id").join(events, ["book_id", "chapter_id"]).select(key, *events.columns)
    both = shown.unionByName(own).dropDuplicates([key, "id"])
    firsts = both.groupBy(key, "segment_id").agg(F.min(F.struct("story_order", "idx", "id", "lane")).alias("f"))
    ranked = firsts.withColumn("s", F.row_number().over(Window.partitionBy(key).orderBy("f.story_order", "f.lane", "segment_id"))).where(F.col("s") <= segments)
    rows = first_rows(both.join(ranked.select(key, "segment_id", "s"), [key, "segment_id"]), [key, "segment_id"], order, each).withColumnRenamed("pos", "n")
    return first_rows(rows, [key], [F.col("s"), F.col("n")], most).select(key, "pos", "id")


def check_parts(focus: DataFrame, blocks: DataFrame, named: DataFrame, events: DataFrame, rules: DataFrame, timeline: DataFrame, key: str, entities: int) -> dict[str, DataFrame]:
    """{entities, events, rules, timeline: (key, pos, text)} of what a consistency check is shown: blocks of the first named entities (id, canonical_name, text) by name, lines of the chapter's first eight events, of the book's rules and of the timeline.

    focus: (key, book_id, chapter_id); named: (key, entity_id); events: (chapter_id, o, line); rules: (book_id, pos, line); timeline: (key, pos, line).
    """
    known = first_rows(named.join(blocks.withColumnRenamed("id", "entity_id"), "entity_id"), [key], [F.col("canonical_name"), F.col("entity_id")], entities)
    own = first_rows(events, ["chapter_id"], [F.col("o")], 8)
    return {
        "entities": known.select(key, "pos", "text"), "events": focus.select(key, "chapter_id").join(own, "chapter_id").select(key, "pos", F.col("line").alias("text")),
        "rules": focus.select(key, "book_id").join(rules, "book_id").select(key, "pos", F.col("line").alias("text")), "timeline": timeline.select(key, "pos", F.col("line").alias("text")),
    }


def check_contexts(parts: list[tuple[str | None, DataFrame]], key: str, most: int) -> DataFrame:
    """(key, context): parts (heading, rows (key, pos, text)) in order, those with a heading as a list under it, cut to `most` characters."""
    blocks = []
    for i, (heading, rows) in enumerate(parts):
        if heading:
            rows = joined(rows, [key], ["pos"], "text", "\n").select(key, F.lit(0).alias("pos"), F.concat(F.lit(heading + "\n"), "text").alias("text"))
        blocks.append(rows.select(key, F.lit(i).alias("part"), "pos", "text"))
    return joined(reduce(DataFrame.union, blocks), [key], ["part", "pos"], "text", "\n\n").select(key, F.left("text", F.lit(most)).alias("context"))


def cleaned_alerts(answers: DataFrame) -> DataFrame:
    """(key, n, kind, severity, message, evidence, suggestion, highlight_text) of the answers (key, answer as JSON text) to a check: of the first three alerts those with a message, their fields cut; an answer that is no list of alerts gives none."""
    one = "struct<kind:string,severity:string,message:string,evidence:string,suggestion:string,highlight_text:string>"
    rows = answers.select("key", F.posexplode(F.slice(F.from_json("answer", f"alerts array<{one}>")["alerts"], 1, 3)).alias("n", "a"))
    text = lambda c, most: F.left(F.trim(_or(F.col("a")[c])), F.lit(most)).alias(c)
    kept = rows.where(F.trim(_or(F.col("a")["message"])) != "")
    named = lambda c, d, most: F.left(_or(F.nullif(F.col("a")[c], F.lit("")), d), F.lit(most)).alias(c)
    return kept.select("key", "n", named("kind", "continuity", 40), named("severity", "medium", 20), text("message", 300), text("evidence", 500), text("suggestion", 300), text("highlight_text", 240))


# ---- chapters


def _touching(hints: DataFrame) -> DataFrame:
    """Hints with chapter_id, once for the chapter they are planted in and once for another they are resolved in."""
    return hints.withColumn("chapter_id", F.explode(F.array_distinct(F.array("hint_chapter_id", "resolved_chapter_id")))).where("chapter_id IS NOT NULL")


def outlines(entities: DataFrame, mentions: DataFrame, chapters: DataFrame, before: DataFrame, rules: DataFrame, events: DataFrame, hints: DataFrame, alerts: DataFrame) -> DataFrame:
    """(chapter_id, part, pos, id, line): what each chapter holds. Entities are placed by initial, name and id; a fact, and an earlier one (before: (entity_id, chapter_id, mention_id)), has the place of its entity.

    rules: (chapter_id, rule_id, name, body, evidence, first_idx); events: with their layout; the latest eight alerts are shown. One chapter's lines are never gathered.
    """
    from storyloom.functions.text import initial_udf

    line = lambda *c: F.concat_ws(" | ", *(_or(x) for x in c)).alias("line")
    place = lambda rows, *order: rows.withColumn("pos", F.row_number().over(Window.partitionBy("chapter_id").orderBy(*order)))
    part = lambda rows, name, key, text: rows.select("chapter_id", F.lit(name).alias("part"), "pos", F.col(key).alias("id"), text)
    known = entities.select(F.col("id").alias("entity_id"), initial_udf("canonical_name").alias("ini"), _or("canonical_name").alias("name"), _or("type").alias("type"))
    heads = place(mentions.select("chapter_id", "entity_id").distinct().join(known, "entity_id"), "ini", "name", "entity_id")
    at = heads.select("chapter_id", "entity_id", "pos")
    facts = mentions.join(at, ["chapter_id", "entity_id"])
    told = mentions.select(F.col("id").alias("mention_id"), F.col("chapter_id").alias("_c"), "fact", "snippet").join(chapters.select(F.col("id").alias("_c"), "idx", "title"), "_c")
    earlier = before.join(at, ["chapter_id", "entity_id"]).join(told, "mention_id")
    ruled = place(rules.distinct().withColumn("ini", initial_udf("name")), "ini", _or("name"), "rule_id", _or("evidence"))
    planted = place(_touching(hints), "id")
    open_ = place(alerts, F.desc("created_at"), "id").where("pos <= 8")
    parts = [
        part(heads, "entity", "entity_id", line("ini", "name", "type")), part(facts, "fact", "id", line("fact", "snippet")), part(earlier, "before", "mention_id", line(chapter_label(F.col("idx")), "title", "fact", "snippet")),
        part(ruled, "rule", "rule_id", line("ini", "name", "body", "evidence", chapter_label(F.col("first_idx")))), part(place(events.where("chapter_id IS NOT NULL"), "story_order", "id"), "event", "id", line("story_time", "who", "what")),
        part(planted, "foreshadowing", "id", line("status", "hint", "resolution")), part(open_, "alert", "id", line("kind", "severity", "message")),
    ]
    return reduce(DataFrame.union, parts)


def dossiers(entities: DataFrame, mentions: DataFrame, chapters: DataFrame, events: DataFrame, rules: DataFrame, hints: DataFrame, elsewhere: DataFrame, most: int = 15) -> DataFrame:
    """(chapter_id, part, id, line): the records of each chapter, and the first `most` facts of its entities in other chapters (elsewhere: (entity_id, chapter_id, mention_id)) by name and place."""
    line = lambda *c: F.concat_ws(" | ", *c).alias("line")
    known = entities.select(F.col("id").alias("entity_id"), "canonical_name", "type")
    facts = mentions.join(known, "entity_id")
    told = facts.select(F.col("id").alias("mention_id"), F.col("chapter_id").alias("_c"), "canonical_name", "type", "fact").join(chapters.select(F.col("id").alias("_c"), "idx"), "_c")
    cross = first_rows(elsewhere.join(told, "mention_id"), ["chapter_id"], [F.col("canonical_name"), F.col("entity_id"), F.col("idx"), F.col("_c"), F.col("mention_id")], most)
    part = lambda rows, name, key, text: rows.select("chapter_id", F.lit(name).alias("part"), F.col(key).alias("id"), text)
    parts = [
        part(facts, "mention", "id", line("canonical_name", "type", "fact")), part(events, "event", "id", line("story_time", "who", "what", "where_loc", "why", "consequence")),
        part(rules.select("chapter_id", "rule_id", "name").distinct(), "rule", "rule_id", F.col("name").alias("line")), part(_touching(hints), "foreshadowing", "id", line("status", "hint", "resolution")),
        part(cross, "cross", "mention_id", line("canonical_name", "type", "fact")),
    ]
    return reduce(DataFrame.union, parts)
