"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import canonical_values, lookalikes, names, near_duplicates, packing, pii, splitting, tokens
from storyloom.session import written
from storyloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"mentions": (table(spark, sf_dir, "mentions"), "id", "fact"), "kb_events": (table(spark, sf_dir, "kb_events"), "id", "what")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_texts(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_texts(spark, sf_dir))


def _name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities")
    codes, labels = _types(spark, sf_dir)
    exact = F.create_map(*(F.lit(x) for label in labels for x in (label, codes[canonical_values.plain(label).strip()])))
    free = canonical_values.mapped_values(entities, "id", "type", codes, labels).select("id", F.col("type_code").alias("code"))
    typed = entities.select("id", exact[F.col("type")].alias("code")).where(F.col("code").isNotNull()).union(free)
    kind = F.create_map(*(F.lit(x) for pair in names.KINDS.items() for x in pair))[F.col("code")]
    kinds = entities.select("id").distinct().join(typed.groupBy("id").agg(F.min("code").alias("code")), "id", "left")
    kinds = kinds.select("id", F.when(F.col("code").isNull(), names.UNKNOWN).otherwise(F.coalesce(kind, F.lit(names.OTHER))).alias("kind"))
    return names.name_groups(written(_unified(spark, sf_dir), "forms"), written(kinds, "kinds"), "book_id")  # both are read several times


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.group_pairs(_name_groups(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_groups(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(splitting.split_pieces(table(spark, sf_dir, "chapter_list"), "chapter_id", "content"), "chapter_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapter_list").select("chapter_id", "content").distinct()
    return splitting.split_pieces(chapters, "chapter_id", "content")


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.rejoined(p4_pieces(spark, sf_dir).where("chapter_id IS NOT NULL"), "chapter_id")


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.unified_names(lookalikes.all_names(table(spark, sf_dir, "entities"), "id", "canonical_name", "aliases", "book_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(written(_unified(spark, sf_dir), "forms"), "book_id")


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir)


def _types(spark: SparkSession, sf_dir: str) -> tuple[dict[str, str], list[str]]:
    reference = table(spark, sf_dir, "entity_types")
    labels = [r["label"] for r in reference.select("label").where("label IS NOT NULL").collect()]
    return canonical_values.terms_of(reference, "type_code", ("label", "label_en"), ("hints",)), labels


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = canonical_values.mapped_values(table(spark, sf_dir, "entities"), "id", "type", *_types(spark, sf_dir))
    return mapped.select("id", "type_code").distinct()


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = canonical_values.mapped_values(table(spark, sf_dir, "entities"), "id", "type", *_types(spark, sf_dir))
    return mapped.where(F.col("type_code") == canonical_values.UNMATCHED).groupBy("type").agg(F.countDistinct("id").alias("entities"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), tokens.vocabulary())


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tokens.decoded(p7_ids(spark, sf_dir), tokens.vocabulary())
    return text.select("doc_id", F.sha2("text", 256).alias("hash"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary()), "sizes")
    return packing.packed(sizes, "doc_id", "n_tokens")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    figures = lookalikes.all_names(table(spark, sf_dir, "entities"), "id", "canonical_name", "aliases").select("name")
    return pii.without_figures(found, figures)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_packed(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, as one row: every text with tokens is packed whole and once, in order, within the capacity, in at most 1 % and one container more than the tokens need."""
    rows = written(p8_packed(spark, sf_dir), "packed")
    own = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("piece_no", "container"))).alias("cs"))
    rising = F.forall(F.sequence(F.lit(0), F.size("cs") - 1), lambda i: (i == 0) | (F.get("cs", i)["container"] >= F.coalesce(F.get("cs", i - 1)["container"], F.lit(0))))
    documents = own.agg(F.count("*").alias("documents"), F.bool_and((F.col("n") == F.col("last") + 1) & (F.col("end") == F.col("tokens"))).alias("whole"), F.bool_and(rising).alias("in_order"))
    filled = packing.fill(rows).agg(F.bool_and(F.col("used") <= packing.CAPACITY).alias("within"), (F.count("*") <= F.ceil(F.sum("used") / packing.CAPACITY) * 1.01 + 1).alias("tight"))
    return documents.crossJoin(filled)  # one row with one row


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "kind", "start_pos", "end_pos").distinct()


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(table(spark, sf_dir, "documents"), _spans(spark, sf_dir), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_groups, p4_found, p4_pieces, p4_rejoined, p5_found, p5_names, p6_found, p6_unmatched, p7_ids, p7_decoded, p8_packed, p8_containers, p8_invariants, p9_found, p9_masked)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": "SELECT DISTINCT chapter_id FROM chapter_list WHERE length(content) > 1500",
        "p4_rejoined": "SELECT DISTINCT chapter_id, sha256(content) AS hash, true AS fits FROM chapter_list WHERE coalesce(content, '') <> '' AND chapter_id IS NOT NULL",
        "p7_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
        "p8_invariants": "SELECT count(*) AS documents, true AS whole, true AS in_order, true AS within, true AS tight FROM documents WHERE coalesce(text, '') <> ''",
    }
