"""The knowledge base as views over the Parquet tables of one folder.

Four tables are there as they are (redelivered rows once); the rest of the twenty are
derived from them by plain SQL that both Spark and the checking engine run, so that every
operator has whole tables to work on. {name} is a base table or another view.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from pyspark.sql import Column, DataFrame, SparkSession

from storyloom.functions.text import initial
from storyloom.sources.tables import table

VIEWS: dict[str, str] = {
    "kb_chapters": "SELECT DISTINCT id, book_id, idx, title, content_hash, summary, status, error, tokens_used, updated_at FROM {chapters} WHERE id IS NOT NULL",
    "kb_texts": "SELECT DISTINCT book_id, chapter_id, title, content, idx FROM {chapter_list}",
    "kb_entities": "SELECT DISTINCT id, book_id, canonical_name, type, aliases, first_chapter_id, updated_at, name_norm, mention_cnt FROM {entities} WHERE id IS NOT NULL",
    "kb_mentions": "SELECT DISTINCT id, entity_id, chapter_id, fact, snippet, created_at, confidence, pass_no FROM {mentions} WHERE id IS NOT NULL",
    "kb_happenings": "SELECT DISTINCT id, book_id, chapter_id, story_time, who, what, where_loc, why, consequence, created_at FROM {kb_events} WHERE id IS NOT NULL",
    "kb_foreshadowing": """
        SELECT concat('f-', id) AS id, book_id, chapter_id AS hint_chapter_id, what AS hint,
          CASE WHEN coalesce(why, '') = '' THEN 'open' ELSE 'resolved' END AS status,
          CASE WHEN coalesce(why, '') = '' THEN NULL ELSE chapter_id END AS resolved_chapter_id,
          CASE WHEN coalesce(why, '') = '' THEN NULL ELSE consequence END AS resolution, created_at AS updated_at
        FROM {kb_happenings} WHERE coalesce(consequence, '') <> ''""",
    "kb_rules": "SELECT id, book_id, canonical_name AS name, concat(coalesce(type, ''), '/', canonical_name) AS body, first_chapter_id, updated_at FROM {kb_entities} WHERE type IN ('规则', '设定', '法则', '概念', '功法', '境界', 'rule', 'law', 'setting')",
    "kb_rule_mentions": "SELECT m.id, m.entity_id AS rule_id, m.chapter_id, m.fact AS evidence, m.created_at FROM {kb_mentions} m JOIN {kb_rules} r ON m.entity_id = r.id",
    "kb_timeline_meta": """
        SELECT id AS event_id, book_id, CAST(created_at % 5000 AS INT) AS story_order, concat('seg', CAST(created_at % 7 AS VARCHAR(9))) AS segment_id,
          concat('Part ', CAST(created_at % 7 AS VARCHAR(9))) AS segment_title, CAST(created_at % 3 AS INT) AS lane, CAST(1 + created_at % 5 AS INT) AS importance,
          CAST(created_at % 3 AS INT) AS zoom_level, CAST(created_at % 100 AS DOUBLE) / 100 AS confidence,
          CASE WHEN created_at % 4 = 0 THEN 'user' WHEN created_at % 4 = 1 THEN 'fallback' ELSE 'ai' END AS status
        FROM {kb_happenings} WHERE coalesce(story_time, '') <> ''""",
    "kb_alerts": """
        SELECT concat('a-', id) AS id, chapter_id, CASE WHEN pass_no = 1 THEN 'character' ELSE 'timeline' END AS kind,
          CASE WHEN confidence < 0.55 THEN 'high' ELSE 'medium' END AS severity, fact AS message, snippet AS evidence,
          CASE WHEN created_at % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status, created_at
        FROM {kb_mentions} WHERE confidence < 0.6""",
    "kb_aliases": "SELECT DISTINCT e.book_id, e.id AS entity_id, a.alias_raw FROM {kb_entities} e JOIN {kb_alias_rows} a ON e.id = a.id",
    # a change log: which field of an entity was set to what, in order of id
    "kb_edits": """
        SELECT event_id AS id, concat('rec', CAST(user_id AS VARCHAR(20))) AS record_id,
          CASE WHEN event_type = 'click' THEN 'fact' ELSE 'snippet' END AS field, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(30)) AS new_value, event_type = 'error' AS undone
        FROM {events}""",
}
_ALIAS_ROWS = {
    "spark": "SELECT id, explode(aliases) AS alias_raw FROM {kb_entities}",
    "duckdb": "SELECT id, unnest(aliases) AS alias_raw FROM {kb_entities}",
}


#: Tables whose redelivered rows repeat an id and its content. One row for each id is the same as distinct rows, and
#: lets the optimizer leave out the columns a query doesn't ask for before the exchange. Rows without an id are no records.
_ONCE = {"kb_chapters": "chapters", "kb_entities": "entities", "kb_mentions": "mentions", "kb_happenings": "kb_events"}
#: What a derived view asks of the table it is made from: as copies are equal, it may be asked before they are removed, and so reaches the scan.
_ASKED = {
    "kb_foreshadowing": {"kb_happenings": "coalesce(consequence, '') <> ''"},
    "kb_rules": {"kb_entities": "type IN ('规则', '设定', '法则', '概念', '功法', '境界', 'rule', 'law', 'setting')"},
    "kb_timeline_meta": {"kb_happenings": "coalesce(story_time, '') <> ''"},
    "kb_alerts": {"kb_mentions": "confidence < 0.6"},
}


@cache
def _compatibility() -> str:
    """For DuckDB, which has the canonical composition only: one row with a map from every character that has a compatibility decomposition to it."""
    pairs = ((c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT MAP {" + ", ".join(f"{quoted(c)}: {quoted(k)}" for c, k in pairs if k != unicodedata.normalize("NFD", c)) + "} AS m"


@cache
def _initials() -> str:
    """For DuckDB: one row with a map from every character of two GBK bytes that has an initial to it."""
    chars = dict.fromkeys(bytes((hi, lo)).decode("gbk", "ignore") for hi in range(0x81, 0xFF) for lo in range(0x40, 0xFF))
    return "SELECT MAP {" + ", ".join(f"'{c}': '{initial(c)}'" for c in chars if len(c) == 1 and not c.isascii() and initial(c) != "#") + "} AS m"


_MADE = {"nfkc": _compatibility, "initials": _initials}


def _sql(name: str, engine: str) -> str | None:
    if name in _MADE and engine == "duckdb":
        return _MADE[name]()
    return _ALIAS_ROWS[engine] if name == "kb_alias_rows" else VIEWS.get(name)


def view(spark: SparkSession, sf_dir: str, name: str, where: Column | str | None = None) -> DataFrame:
    """The rows of a view or base table of a folder for which `where` holds. It is asked before copies of a row are removed, so that it is pushed into the scan."""
    sql = _sql(name, "spark")
    if sql is None or name in _ONCE:
        rows = table(spark, sf_dir, _ONCE.get(name, name))
        if name in _ONCE:
            rows = rows.drop("arrived_at").where("id IS NOT NULL")
        if where is not None:
            rows = rows.where(where)
        return rows.dropDuplicates(["id"]) if name in _ONCE else rows
    names = set(re.findall(r"\{(\w+)\}", sql))
    asked = _ASKED.get(name, {})
    rows = spark.sql(sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING").replace("VARCHAR(30)", "STRING"), **{n: view(spark, sf_dir, n, asked.get(n)) for n in names})
    return rows if where is None else rows.where(where)


def with_views(sql: str) -> str:
    """SQL for the checking engine: {name} stands for a view or table, the views it needs come before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            own = _sql(n, "duckdb")
            if own is not None and n not in order:
                if n not in _MADE:
                    need(own)
                order.append(n)

    need(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    views = ", ".join(f"{n} AS MATERIALIZED ({_MADE[n]() if n in _MADE else plain(_sql(n, 'duckdb'))})" for n in order)
    body = plain(sql).strip()
    if not views:
        return body
    # RECURSIVE is allowed, and needed by some, for all of them
    return f"WITH RECURSIVE {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
