"""Filters: predicate trees over metadata, type compatibility, gates by content hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for one kind of entity, words that go with any kind, and the fields that may be edited by hand, by table.
TYPE_CLASSES = (("人物",), ("地点", "场所"), ("势力", "组织", "阵营"), ("物品", "道具"), ("事件",), ("规则", "设定"))
ANY_TYPE = ("未分类", "未知")
EDITABLE = {
    "entities": ("canonical_name", "type", "aliases", "first_chapter_id"),
    "mentions": ("fact", "snippet", "chapter_id"),
    "events": ("story_time", "who", "what", "where_loc", "why", "consequence", "chapter_id"),
    "foreshadowing": ("hint", "status", "resolved_chapter_id", "resolution", "hint_chapter_id"),
    "rules": ("name", "body", "first_chapter_id"),
}
# End of the fixed values.


def metadata_matches(where: object, metadata: Column) -> Column:
    """A predicate tree over a map column as one column expression.

    {key: value} and {key: {$eq, $ne, $in, $nin: ...}}, all keys required; a missing key compares as null.
    $and and $or take lists and hide the keys beside them. An empty tree is true, anything else but a mapping false, as is $and or $or without a list.
    """
    if not where:
        return F.lit(True)
    if not isinstance(where, dict):
        return F.lit(False)
    for word, join, neutral in (("$and", Column.__and__, True), ("$or", Column.__or__, False)):
        if word in where:
            if not isinstance(where[word], list):
                return F.lit(False)
            return reduce(join, (metadata_matches(w, metadata) for w in where[word]), F.lit(neutral))
    tests = []
    for key, wanted in where.items():
        value = F.try_element_at(metadata, F.lit(key))
        tests += [_test(value, op, x) for op, x in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items()]
    return reduce(Column.__and__, tests, F.lit(True))


def _test(value: Column, op: str, wanted: object) -> Column:
    text = lambda x: F.lit(None if x is None else str(x))
    if op in ("$eq", "$ne"):
        same = value.eqNullSafe(text(wanted))
        return same if op == "$eq" else ~same
    if op in ("$in", "$nin"):
        among = F.coalesce(value.isin(*(str(x) for x in wanted if x is not None)), F.lit(False)) if wanted else F.lit(False)
        if None in wanted:
            among = among | value.isNull()
        return among if op == "$in" else ~among
    return F.lit(True)  # an operator that is not known asks for nothing


def types_compatible(a: Column, b: Column) -> Column:
    """Whether entities of two types may be one: equal types, words of one class, or one of them null, empty or a word for any kind. A type in no class goes with itself only."""
    known = {t: str(i) for i, words in enumerate(TYPE_CLASSES) for t in words}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    a, b = (F.coalesce(F.nullif(c, F.lit("")), F.lit(ANY_TYPE[0])) for c in (a, b))
    return (a == b) | a.isin(*ANY_TYPE) | b.isin(*ANY_TYPE) | F.coalesce(F.try_element_at(table, a) == F.try_element_at(table, b), F.lit(False))


def all_of(**tests: object) -> Column:
    """Equality with every argument that is not None."""
    return reduce(Column.__and__, (F.col(k) == F.lit(v) for k, v in tests.items() if v is not None), F.lit(True))


def mentions_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words, in any case; no words ask for nothing."""
    return reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w.lower())) for w in words), F.lit(not words))


def editable(changes: DataFrame) -> DataFrame:
    """Changes (table_name, field) that the whitelist permits."""
    allowed = reduce(Column.__or__, ((F.col("table_name") == t) & F.col("field").isin(*fields) for t, fields in EDITABLE.items()))
    return changes.where(allowed)


def existing(changes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Changes (table_name, record_id) with `known`: whether the record is there. Only the tables of EDITABLE can be; a mention needs an entity too.

    tables: those tables, each with id, mentions with entity_id.
    """
    ids = [tables[t].select(F.lit(t).alias("table_name"), F.col("id").alias("record_id")) for t in EDITABLE if t != "mentions"]
    owned = tables["mentions"].join(tables["entities"].select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    every = reduce(DataFrame.union, [*ids, owned.select(F.lit("mentions"), F.col("id"))]).distinct().withColumn("_there", F.lit(True))
    return changes.join(every, ["table_name", "record_id"], "left").withColumn("known", F.coalesce("_there", F.lit(False))).drop("_there")


def searched(rows: DataFrame, columns: list[str], parts: list[DataFrame], query: str) -> DataFrame:
    """rows (id, columns) whose columns or parts (id, part) contain the query in any case; a blank query asks for all. A hit lies within one column or part."""
    if not query.strip():
        return rows
    word = F.lit(query.lower())
    hits = [rows.where(reduce(Column.__or__, (F.contains(F.lower(c), word) for c in columns))).select("id"), *(p.where(F.contains(F.lower("part"), word)).select("id") for p in parts)]
    return rows.join(reduce(DataFrame.union, hits), "id", "left_semi")


def hash_gate(known: DataFrame, texts: DataFrame) -> DataFrame:
    """(chapter_id, changed) of each text: unchanged if its chapter is done with the hash of this content. Empty content has the hash ''."""
    content = F.coalesce(F.col("content"), F.lit(""))
    now = texts.select("chapter_id", F.when(content == "", "").otherwise(F.sha2(content, 256)).alias("now"))
    done = known.where("status = 'done'").select(F.col("id").alias("chapter_id"), "content_hash").distinct()
    held = done.withColumnRenamed("content_hash", "now").withColumn("same", F.lit(True)).dropDuplicates(["chapter_id", "now"])
    return now.join(held, ["chapter_id", "now"], "left").select("chapter_id", F.col("same").isNull().alias("changed"))


def new_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks not registered with this id, content_hash and backend_id: those that have to be embedded."""
    return chunks.join(registry, ["id", "content_hash", "backend_id"], "left_anti")
