"""Edits of single fields under review: values read and written by (table, record, field), proposals, the log and its undoing; queues, runs and admission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.changes import upserted
from storyloom.operators.predicates import EDITABLE

#: Columns of a run's state that may be set.
RUN_COLUMNS = ("status", "current_idx", "total", "phase", "error", "pause_requested", "active_start_idx", "active_end_idx")


def field_values(kb: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """wanted (table_name, record_id, field) with `known`, whether there is such a record and the field may be edited, and its `value` as text. Only the records wanted are unpivoted; a mention counts only with its entity."""
    out = []
    for table, fields in EDITABLE.items():
        own = wanted.where((F.col("table_name") == table) & F.col("field").isin(*fields))
        rows = kb[table].join(own.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")
        if table == "mentions":
            rows = rows.join(kb["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        text = lambda c: F.to_json(c) if c == "aliases" else F.col(c).cast("string")
        cells = rows.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields))).alias("c"))
        out.append(cells.select(F.lit(table).alias("table_name"), F.col("id").alias("record_id"), "c.field", "c.value", F.lit(True).alias("known")))
    values = reduce(DataFrame.union, out)
    return wanted.join(values, ["table_name", "record_id", "field"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def logged_edits(kb: dict[str, DataFrame], edits: DataFrame, source: str) -> DataFrame:
    """The log entries (id, table_name, record_id, field, old_value, new_value, source) of edits (id, table_name, record_id, field, new_value) made in order of id: each with the value it replaces. Edits of what is not there or may not be edited are refused."""
    fields = ["table_name", "record_id", "field"]
    known = field_values(kb, edits.select(*fields).distinct()).where("known").select(*fields, "value")
    before = F.lag(F.struct("new_value")).over(Window.partitionBy(*fields).orderBy("id"))
    rows = edits.join(known, fields).withColumn("_b", before)
    return rows.select("id", *fields, F.when(F.col("_b").isNull(), F.col("value")).otherwise(F.col("_b.new_value")).alias("old_value"), "new_value", F.lit(source).alias("source"))


def confirmed(kb: dict[str, DataFrame], proposals: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, log entries) after the pending proposals in ids (id) are confirmed: the value replaced is read anew, not taken from the proposal."""
    chosen = proposals.where("status = 'pending'").join(ids, "id", "left_semi")
    log = logged_edits(kb, chosen, "ai-confirmed")
    done = log.select("id", F.lit("confirmed").alias("_s"))
    return proposals.join(done, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s"), log.withColumn("proposal_id", F.col("id"))


def undone(log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, inverse entries) after the entries in ids (id) are undone: they are flagged, and entries that write their old value back, null included, are added. An entry undone before is left alone."""
    chosen = log.where("NOT undone").join(ids, "id", "left_semi")
    flags = chosen.select("id", F.lit(True).alias("_u"))
    flagged = log.join(flags, "id", "left").withColumn("undone", F.coalesce("_u", "undone")).drop("_u")
    return flagged, chosen.select(F.col("id").alias("undoes"), "table_name", "record_id", "field", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"), F.lit("undo").alias("source"))


def written_back(rows: DataFrame, table: str, log: DataFrame) -> DataFrame:
    """rows of a table with the fields set to the last value (by id) its log entries give them."""
    last = log.where(F.col("table_name") == table).groupBy(F.col("record_id").alias("id"), "field").agg(F.max(F.struct(F.col("id").alias("n"), "new_value")).alias("v"))
    sets = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("v.new_value").alias("x"))))).alias("_set"))  # as many as a record has fields
    out = rows.join(sets, "id", "left")
    for c in EDITABLE[table]:
        cell = F.try_element_at("_set", F.lit(c))
        value = F.from_json(cell["x"], "array<string>") if c == "aliases" else cell["x"].cast(rows.schema[c].dataType)
        out = out.withColumn(c, F.when(cell.isNull(), F.col(c)).otherwise(value))
    return out.drop("_set")


def states_set(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Run states (book_id, ...) with changes put in: columns not in RUN_COLUMNS are ignored, a null keeps the old value, a new run is idle before its first chapter."""
    known = changes.select("book_id", *(c for c in changes.columns if c in RUN_COLUMNS))
    return upserted(states, known, ["book_id"], {"status": "idle", "current_idx": -1, "total": 0, "pause_requested": False, "active_start_idx": -1, "active_end_idx": -1})


def restarted(queue: DataFrame) -> DataFrame:
    """The queue at a start: what was being processed is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def admitted(tasks: DataFrame, slots: int = 1) -> DataFrame:
    """tasks (id, heavy, status, asked) with `go`: a pending light task always may start, of the pending heavy ones as many as slots are free, those asked for first."""
    busy = tasks.where("heavy AND status = 'running'").limit(slots).count()  # at most slots rows are counted
    first = tasks.where("heavy AND status = 'pending'").orderBy("asked", "id").limit(max(0, slots - busy)).select("id", F.lit(True).alias("_go"))
    go = (F.col("status") == "pending") & (~F.col("heavy") | F.coalesce("_go", F.lit(False)))
    return tasks.join(first, "id", "left").withColumn("go", go).drop("_go")


def buffers(tokens: DataFrame, most: int) -> DataFrame:
    """(run_id, text): the last `most` characters of what each run wrote, from its tokens (run_id, n, token). Only tokens that reach into the tail are joined."""
    over = Window.partitionBy("run_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    tail = tokens.withColumn("_after", F.coalesce(F.sum(F.length("token")).over(over), F.lit(0))).where(F.col("_after") < most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), "")
    return tail.groupBy("run_id").agg(text.alias("text")).select("run_id", F.right("text", F.lit(most)).alias("text"))


def halved(batches: DataFrame, failed: DataFrame) -> DataFrame:
    """(batch, part, pos, id): batches (batch, pos, id) to be tried next: a failed one of several in two halves, the first the larger; one of a single item fails for good and does not come again, the others are done."""
    sized = batches.join(failed, "batch", "left_semi").withColumn("_n", F.count("*").over(Window.partitionBy("batch"))).where("_n > 1")
    place = F.row_number().over(Window.partitionBy("batch").orderBy("pos"))
    return sized.withColumn("_r", place).select("batch", F.when(F.col("_r") <= F.ceil(F.col("_n") / 2), 0).otherwise(1).alias("part"), "pos", "id")


def aligned(results: DataFrame, chapters: DataFrame) -> DataFrame:
    """(batch, chapter_id, result): results (batch, place, chapter_idx, result) given to the chapters (batch, place, idx, chapter_id) of their batch, by place if there are as many as chapters, else by the index each states."""
    counts = results.groupBy("batch").agg(F.count("*").alias("_r")).join(chapters.groupBy("batch").agg(F.count("*").alias("_c")), "batch")
    same = counts.select("batch", (F.col("_r") == F.col("_c")).alias("_same"))
    own = results.join(same, "batch")
    by_place = own.where("_same").join(chapters, ["batch", "place"]).select("batch", "chapter_id", "result")
    by_idx = own.where("NOT _same").drop("place").join(chapters.withColumnRenamed("idx", "chapter_idx"), ["batch", "chapter_idx"]).select("batch", "chapter_id", "result")
    return by_place.union(by_idx)
