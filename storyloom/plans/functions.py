"""Queries of functions/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import budget, json, text
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()


@query(f"SELECT id, {text.normal_name_sql('canonical_name')} AS normal FROM {{kb_entities}} CROSS JOIN {{nfkc}} nf")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, D23"""
    return view(spark, sf_dir, "kb_entities").select("id", text.normal_name_udf("canonical_name").alias("normal"))


@query(f"SELECT id, {text.initial_sql('canonical_name')} AS initial FROM {{kb_entities}} CROSS JOIN {{initials}} ini")
def name_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12"""
    return view(spark, sf_dir, "kb_entities").select("id", text.initial_udf("canonical_name").alias("initial"))


@query("SELECT chapter_id, CASE WHEN coalesce(content, '') = '' THEN '' ELSE sha256(content) END AS hash FROM {kb_texts}")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2"""
    return view(spark, sf_dir, "kb_texts").select("chapter_id", text.content_hash(F.col("content")).alias("hash"))


_T = "CAST(floor({0} * 0.55::DOUBLE) AS INT)"
_N = "length(coalesce(content, ''))"
_CTX = f"(CAST(idx AS BIGINT) * 4000 - 4000)"


@query(f"""
SELECT chapter_id, {_T.format(_N)} AS tokens, CASE WHEN {_CTX} <= 0 THEN 8192 ELSE greatest(4096, least({_CTX} - ({_T.format('length(coalesce(title, $$$$))')} + {_T.format(_N)} + 1500) - 2000, 131072)) END AS output,
  CAST(greatest(4000, {_CTX} - (2000 + {_T.format(_N)} + idx + greatest(2000, {_CTX} // 16) + {_CTX} // 20)) AS BIGINT) AS budget,
  {_CTX} - (2000 + {_T.format(_N)} + idx + greatest(2000, {_CTX} // 16) + {_CTX} // 20) < 4000 AS compress,
  CAST(CASE WHEN {_CTX} < 16000 THEN 1 ELSE greatest(2, (CAST(floor({_CTX} * 0.9::DOUBLE) AS BIGINT) - 4000) // 7500) END AS INT) AS chapters,
  CAST(CASE WHEN {_CTX} <= 0 THEN 4000 ELSE greatest(2500, least(12000, {_CTX} // 20)) END AS INT) AS before,
  {_CTX} > 0 AND {_T.format(_N)} + {_T.format(_N)} + 1500 + 3 * 6000 + 2000 <= floor({_CTX} * 0.9::DOUBLE) AS fits FROM {{kb_texts}} WHERE idx IS NOT NULL""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, F5, F6"""
    n, title, context = F.length(F.coalesce("content", F.lit(""))), F.length(F.coalesce("title", F.lit(""))), F.col("idx").cast("bigint") * 4000 - 4000
    smart = budget.context_budget(context, budget.tokens(n), F.col("idx"))
    return view(spark, sf_dir, "kb_texts", "idx IS NOT NULL").select(
        "chapter_id", budget.tokens(n).alias("tokens"), budget.output_budget(context, n, title).alias("output"), smart["budget"].alias("budget"), smart["compress"].alias("compress"),
        budget.most_chapters(context).alias("chapters"), budget.context_before(context).alias("before"), budget.batch_fits(context, n, n, F.lit(3)).alias("fits"),
    )


@query("SELECT id, list_filter(list_distinct(list_transform(aliases, lambda x: trim(x, ' '))), lambda x: x <> '') IS NULL AS missing, CAST(coalesce(len(list_filter(list_distinct(list_transform(aliases, lambda x: trim(x, ' '))), lambda x: x <> '')), 0) AS INT) AS n FROM {kb_entities}")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases written as JSON and read again"""
    return view(spark, sf_dir, "kb_entities").select("id", F.col("aliases").isNull().alias("missing"), F.size(json.aliases(F.to_json("aliases"))).alias("n"))


_RAW = """CASE created_at % 5 WHEN 0 THEN concat('```json\n{"id": "', id, '"}\n```') WHEN 1 THEN concat('Here: {"id": "', id, '"} done') WHEN 2 THEN concat('[{"id": "', id, '"}, {"id": ')
  WHEN 3 THEN concat('x [1, "', id, '"] y') ELSE 'no json' END"""


_OBJECT = "concat(chr(123), '\"id\": \"', id, '\"', chr(125))"
_LIST_OF_ONE = "concat('[1, \"', id, '\"]')"


@query(f"""
SELECT id, CASE WHEN created_at % 5 < 3 THEN {_OBJECT} WHEN created_at % 5 = 3 THEN {_LIST_OF_ONE} ELSE 'null' END AS found,
  CASE created_at % 5 WHEN 2 THEN concat('[', {_OBJECT}, ']') WHEN 3 THEN {_LIST_OF_ONE} END AS items FROM {{kb_happenings}}""")
def json_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, in prose, broken off, a list, none"""
    raw = F.expr(_RAW)
    rows = view(spark, sf_dir, "kb_happenings").select("id", "created_at", raw.alias("raw"))
    return rows.select("id", json.recovered(F.col("raw"), "null").alias("found"), F.when((F.col("created_at") % 5).isin(2, 3), json.array_text(F.col("raw"))).alias("items"))


@query("SELECT id, concat_ws(', ', nullif(who, ''), nullif(where_loc, ''), nullif(why, '')) AS joined FROM {kb_happenings}")
def values_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11"""
    return view(spark, sf_dir, "kb_happenings").select("id", text.joined_values(F.array("who", "where_loc", "why")).alias("joined"))


@query("""
SELECT id, CASE created_at % 6 WHEN 0 THEN concat_ws(', ', nullif(who, ''), '7') WHEN 1 THEN who WHEN 2 THEN '' WHEN 3 THEN '42' WHEN 4 THEN 'true' ELSE '{"a":1}' END AS said FROM {kb_happenings} WHERE who IS NOT NULL""")
def loose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of any kind as text"""
    t, who = F.col("created_at") % 6, F.to_json(F.struct("who"))
    quoted = F.regexp_extract(who, r'(?s)^\{"who":(.*)\}$', 1)
    raw = F.when(t == 0, F.concat(F.lit("["), quoted, F.lit(', null, "", 0, 7]'))).when(t == 1, quoted).when(t == 2, "null").when(t == 3, "42").when(t == 4, "true").otherwise('{"a":1}')
    return view(spark, sf_dir, "kb_happenings", "who IS NOT NULL").select("id", json.loose_text(raw).alias("said"))


@query("""
SELECT id, coalesce(nullif(substr(regexp_replace(canonical_name, '[\\\\/:*?"<>|]', '_', 'g'), 1, 100), ''), id) AS filename, CASE WHEN length(canonical_name) > 8 THEN concat(substr(canonical_name, 1, 5), '...') ELSE canonical_name END AS short FROM {kb_entities}""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F21, D24"""
    name = F.col("canonical_name")
    return view(spark, sf_dir, "kb_entities").select("id", text.safe_filename(name, F.col("id")).alias("filename"), text.shortened(name, 8).alias("short"))


@query("SELECT id, CASE WHEN idx IS NULL THEN '?' ELSE concat('第 ', CAST(idx + 1 AS VARCHAR), ' 章') END AS label, CASE WHEN idx % 4 = 1 THEN concat('own: ', coalesce(title, '')) ELSE concat('新一卷《', coalesce(title, ''), '》开始了。故事延续自世界观「', book_id, '」。') END AS prompt FROM {kb_chapters} WHERE book_id IS NOT NULL")
def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter with a prompt of their own"""
    own = F.when(F.col("idx") % 4 == 1, F.concat(F.lit("own: "), F.coalesce("title", F.lit(""))))
    return view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL").select("id", text.chapter_label(F.col("idx")).alias("label"), text.volume_prompt(F.col("title"), F.col("book_id"), own).alias("prompt"))


@query(r"""
SELECT doc_id, regexp_matches(text, '第\s*\d+\s*章|什么时候|时间线|顺序|经过') AS timeline, regexp_matches(text, '伏笔|悬念|线索|未解|铺垫') AS hints,
  CAST(len(regexp_extract_all(text, '第\s*(\d+)\s*章', 1)) AS INT) AS named, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '第\s*(\d+)\s*章', 1), lambda n: CAST(n AS BIGINT) - 1)), 0) AS BIGINT) AS idx_sum FROM documents WHERE text IS NOT NULL""")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F17"""
    asked = text.chapters_asked_for(F.col("text"))
    total = F.aggregate(asked, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return view(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.asks_for_timeline(F.col("text")).alias("timeline"), text.asks_for_hints(F.col("text")).alias("hints"), F.size(asked).alias("named"), total.alias("idx_sum"))


@query("SELECT id, canonical_name AS entity, 'before  after' AS rest FROM {kb_entities} WHERE canonical_name IS NOT NULL AND NOT contains(canonical_name, '\"') AND NOT contains(canonical_name, chr(92)) AND canonical_name <> ''")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18"""
    name = F.col("canonical_name")
    said = F.concat(F.lit('before [QUERY_KB]{"entity": "'), name, F.lit('"}[/QUERY_KB] after'))
    rows = view(spark, sf_dir, "kb_entities", name.isNotNull() & (name != "") & ~F.contains(name, F.lit('"')) & ~F.contains(name, F.lit("\\")))
    calls = json.tool_calls(said)
    return rows.select("id", F.element_at(calls["entities"], 1).alias("entity"), calls["rest"].alias("rest"))


@query("SELECT id, concat(coalesce(fact, ''), '|', coalesce(snippet, '')) AS buffer, least(0.95, confidence + 0.1::DOUBLE) AS raised, pass_no + 1 AS pass_no FROM {kb_mentions}")
def confidence_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22, F23"""
    buffer = F.concat(F.coalesce("fact", F.lit("")), F.lit("|"), F.coalesce("snippet", F.lit("")))
    return view(spark, sf_dir, "kb_mentions").select("id", buffer.alias("buffer"), F.least(F.lit(0.95), F.col("confidence") + 0.1).alias("raised"), (F.col("pass_no") + 1).alias("pass_no"))




@query(r"""
SELECT chapter_id, CASE WHEN length(t) > 200 THEN concat(substr(t, 1, 200), '...') ELSE t END AS text, CAST(length(t) AS INT) AS full_length, length(t) > 200 AS truncated
FROM (SELECT chapter_id, trim(regexp_replace(content, '[\s\x0b\x85\pZ]+', ' ', 'g'), ' ') AS t FROM {kb_texts})""")
def texts_squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25"""
    s = text.squashed(F.col("content"), 200)
    return view(spark, sf_dir, "kb_texts").select("chapter_id", s["text"].alias("text"), s["full_length"].alias("full_length"), s["truncated"].alias("truncated"))


@query("SELECT id, CASE WHEN idx % 2 = 0 THEN concat('https://books.example/', id) ELSE concat('http://books.example/', id) END AS url FROM {kb_chapters}")
def urls_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26"""
    bare = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("books.example/"), "id")).otherwise(F.concat(F.lit("http://books.example/"), "id"))
    return view(spark, sf_dir, "kb_chapters").select("id", text.with_scheme(bare).alias("url"))


@query("""
SELECT id, regexp_replace(replace(replace(replace(replace(replace(fact, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(?i)(the)', '<mark>\\1</mark>', 'g') AS shown FROM {kb_mentions}""")
def words_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27"""
    return view(spark, sf_dir, "kb_mentions").select("id", text.highlighted(F.col("fact"), "the").alias("shown"))


@query("""
WITH t AS (SELECT id, regexp_extract_all(lower(coalesce(fact, '')), '([一-鿿]|[a-z0-9_]+)', 1) AS w FROM {kb_mentions})
SELECT id, CAST(3 * len(w) - CASE WHEN len(w) >= 2 THEN 3 WHEN len(w) = 1 THEN 2 ELSE 0 END AS BIGINT) AS n, concat(array_to_string(w, ''), '|', coalesce(w[1], ''), coalesce(w[2], '')) AS seen FROM t""")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features of hash embeddings"""
    words = F.regexp_extract_all(F.lower(F.coalesce("fact", F.lit(""))), F.lit("([\\u4e00-\\u9fff]|[a-z0-9_]+)"), 1)
    rows = view(spark, sf_dir, "kb_mentions").select("id", text.ngram_features(F.col("fact")).alias("grams"), words.alias("words"))
    first = F.when(F.size("words") >= 2, F.get("grams", F.size("words"))).otherwise(F.coalesce(F.get("grams", F.lit(0)), F.lit("")))
    return rows.select("id", F.size("grams").cast("bigint").alias("n"), F.concat(F.array_join(F.slice("grams", F.lit(1), F.size("words")), ""), F.lit("|"), first).alias("seen"))
