"""The twenty tables of a knowledge base, with the values that columns added later take in older data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "chapters": "id string, book_id string, idx int, title string, content_hash string, summary string, status string, error string, tokens_used int, updated_at bigint",
    "entities": "id string, book_id string, canonical_name string, type string, aliases array<string>, first_chapter_id string, updated_at bigint, name_norm string, mention_cnt int",
    "mentions": "id string, entity_id string, chapter_id string, fact string, snippet string, created_at bigint, confidence double, pass_no int",
    "events": "id string, book_id string, chapter_id string, story_time string, who string, what string, where_loc string, why string, consequence string, created_at bigint",
    "foreshadowing": "id string, book_id string, hint_chapter_id string, hint string, status string, resolved_chapter_id string, resolution string, updated_at bigint",
    "rules": "id string, book_id string, name string, body string, first_chapter_id string, updated_at bigint",
    "rule_mentions": "id string, rule_id string, chapter_id string, evidence string, created_at bigint",
    "timeline_event_meta": "event_id string, book_id string, story_order int, segment_id string, segment_title string, lane int, importance int, zoom_level int, confidence double, status string, reason string, evidence string, updated_at bigint",
    "timeline_relations": "id string, book_id string, source_event_id string, target_event_id string, relation string, confidence double, status string, evidence string, note string, created_at bigint",
    "consistency_alerts": "id string, book_id string, chapter_id string, kind string, severity string, message string, evidence string, suggestion string, status string, source_hash string, created_at bigint, updated_at bigint",
    "rt_state": "book_id string, status string, current_idx int, total int, phase string, error string, pause_requested boolean, stream_buffer string, active_start_idx int, active_end_idx int, updated_at bigint",
    "rt_logs": "id bigint, book_id string, ts string, msg string",
    "embedding_chunks": "id string, book_id string, source_type string, source_id string, content_hash string, backend_id string, embedded_at bigint",
    "vector_entries": "id string, book_id string, embedding array<float>, dimensions int, document string, metadata map<string,string>, updated_at bigint",
    "kb_proposals": "id string, book_id string, table_name string, record_id string, field string, old_value string, new_value string, reason string, status string, source_message string, created_at bigint, resolved_at bigint",
    "kb_edit_log": "id bigint, book_id string, table_name string, record_id string, field string, old_value string, new_value string, reason string, source string, proposal_id string, created_at bigint, undone boolean",
    "entity_aliases": "id string, book_id string, entity_id string, alias_norm string, alias_raw string, source string, created_at bigint",
    "entity_merges": "id string, book_id string, from_name string, into_id string, reason string, similarity double, created_at bigint",
    "fact_revisions": "id string, book_id string, entity_id string, chapter_id string, fact string, snippet string, confidence double, pass_no int, status string, supersedes string, reason string, created_at bigint",
    "kb_dirty_queue": "id string, work_id string, book_id string, chapter_id string, reason string, enqueued_at bigint, status string, attempts int",
}
DEFAULTS = {
    "chapters": {"status": "pending", "tokens_used": 0},
    "entities": {"name_norm": "", "mention_cnt": 0},
    "mentions": {"confidence": 0.6, "pass_no": 1},
    "foreshadowing": {"status": "open"},
    "timeline_event_meta": {"lane": 0, "importance": 2, "zoom_level": 2, "confidence": 0.5, "status": "ai"},
    "timeline_relations": {"confidence": 0.5},
    "consistency_alerts": {"status": "open"},
    "rt_state": {"current_idx": -1, "active_start_idx": -1, "active_end_idx": -1, "pause_requested": False},
    "kb_proposals": {"status": "pending"},
    "kb_edit_log": {"undone": False},
    "fact_revisions": {"status": "active"},
    "kb_dirty_queue": {"status": "pending", "attempts": 0},
}
TABLES = tuple(_DDL)


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def migrated(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of the table in order: missing ones take their default, others are cast, unknown ones dropped."""
    defaults = DEFAULTS.get(table, {})
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(table)))
