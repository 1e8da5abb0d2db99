"""Queries of operators/provenance.py and operators/pages.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import pages as web
from storyloom.operators import provenance as op
from storyloom.plans.base import registry
from storyloom.sources.views import view

QUERIES, SQL, query = registry()

# A container of every book, with one event a chapter, chained; books are spoilt in one of eight ways, by their number of chapters.
_SPOILT = ("bad_event_hash", "broken_link", "no_author", "files_differ", "no_manifest", "wrong_format", "unsupported_version", "no_history")


def _containers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, history, files) as provenance.verified() takes them. A history is chained from event to event, so one is made in one row; it is input, and as long as a book has chapters."""
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL AND idx IS NOT NULL").select(F.col("book_id").alias("work_id"), "id", "idx", F.coalesce("content_hash", F.lit("")).alias("hash"))
    books = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "hash"))).alias("cs")).withColumn("n", F.size("cs")).withColumn("fault", F.col("n") % 9)
    at, one = F.floor(F.col("n") / 2).cast("int"), lambda c: F.concat(F.lit('{"path":"'), c["id"], F.lit('","sha256":"'), c["hash"], F.lit('","size":'), c["idx"].cast("string"), F.lit("}"))
    every = F.array_join(F.transform(F.array_sort(F.transform("cs", lambda c: F.struct(c["id"].alias("id"), c["hash"].alias("hash"), c["idx"].alias("idx")))), one), ",")

    def step(acc, pos):
        spoilt = lambda k: (F.col("fault") == k) & (pos == at)
        files = F.when(pos == F.col("n") - 1, every).otherwise(one(F.get("cs", pos)))
        previous = F.when(spoilt(2), "lost").otherwise(acc["hash"])
        body = F.concat(F.lit('{"author":"'), F.when(spoilt(3), " ").otherwise("editor"), F.lit('","changed_files":['), files, F.lit('],"previous_event_hash":"'), previous, F.lit('"'))
        own = F.sha2(F.concat(body, F.lit("}")), 256)
        line = F.concat(body, F.lit(',"event_hash":"'), F.when(spoilt(1), "wrong").otherwise(own), F.lit('"}'))
        return F.struct(own.alias("hash"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    start = F.struct(F.lit("").alias("hash"), F.array().cast("array<string>").alias("lines"))
    chained = books.withColumn("lines", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, step)["lines"])
    history = chained.where("fault <> 8").select("work_id", F.posexplode("lines").alias("pos", "line"))
    manifest = F.when(F.col("fault") == 6, '{"format_name": "zip", "format_version": 2}').when(F.col("fault") == 7, '{"format_name": "work", "format_version": 3}').when(F.col("fault") != 5, '{"format_name": "work", "format_version": 2}')
    files = books.select("work_id", "fault", F.explode("cs").alias("c")).select("work_id", F.col("c.id").alias("path"), F.when(F.col("fault") == 4, F.concat("c.hash", F.lit("?"))).otherwise(F.col("c.hash")).alias("sha256"), F.col("c.idx").alias("size"))
    return books.select("work_id", manifest.alias("manifest")), history, files


@query("""
SELECT work_id, fault = 0 AS ok, CASE fault WHEN 1 THEN 'bad_event_hash' WHEN 2 THEN 'broken_link' WHEN 3 THEN 'no_author' WHEN 4 THEN 'files_differ' WHEN 5 THEN 'no_manifest' WHEN 6 THEN 'wrong_format' WHEN 7 THEN 'unsupported_version' WHEN 8 THEN 'no_history' END AS reason,
  CASE WHEN fault IN (1, 2, 3) THEN n // 2 WHEN fault = 4 THEN n - 1 END AS pos
FROM (SELECT book_id AS work_id, CAST(count(*) AS INT) AS n, count(*) % 9 AS fault FROM {kb_chapters} WHERE book_id IS NOT NULL AND idx IS NOT NULL GROUP BY book_id)""")
def containers_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six conditions, each broken in some books at a place that is known"""
    return op.verified(*_containers(spark, sf_dir))


@query("""
WITH was AS (SELECT book_id AS work_id, string_agg(concat('{"path":"', id, '","sha256":"', coalesce(content_hash, ''), '","size":', CAST(idx AS VARCHAR), '}'), ',' ORDER BY id) AS files, sha256(book_id) AS event_hash FROM {kb_chapters} WHERE book_id IS NOT NULL AND idx IS NOT NULL GROUP BY ALL),
now AS (SELECT book_id AS work_id, string_agg(concat('{"path":"', id, '","sha256":"', coalesce(CASE WHEN idx % 7 = 6 THEN 'edited' ELSE content_hash END, ''), '","size":', CAST(idx AS VARCHAR), '}'), ',' ORDER BY id) AS files FROM {kb_chapters} WHERE book_id IS NOT NULL AND idx IS NOT NULL GROUP BY ALL)
SELECT n.work_id, 5 AS pos, sha256(concat('{"author":"editor","changed_files":[', n.files, '],"previous_event_hash":"', w.event_hash, '"}')) AS event_hash FROM now n JOIN was w ON w.work_id = n.work_id WHERE n.files <> w.files""")
def history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for every book of which a chapter changed, none for the others"""
    rows = view(spark, sf_dir, "kb_chapters", "book_id IS NOT NULL AND idx IS NOT NULL").select(F.col("book_id").alias("work_id"), F.col("id").alias("path"), F.coalesce("content_hash", F.lit("")).alias("sha256"), F.col("idx").cast("bigint").alias("size"))
    last = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("files")).withColumns({"pos": F.lit(4), "event_hash": F.sha2("work_id", 256)})
    edited = rows.withColumn("sha256", F.when(F.col("size") % 7 == 6, "edited").otherwise(F.col("sha256")))
    return op.appended(last, edited, "editor").select("work_id", "pos", F.get_json_object("line", "$.event_hash").alias("event_hash"))


@query("SELECT concat('chapters/', chapter_id, '.txt') AS path, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS INT) AS size FROM {kb_texts} WHERE content IS NOT NULL AND chapter_id IS NOT NULL")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3"""
    files = view(spark, sf_dir, "kb_texts", "content IS NOT NULL AND chapter_id IS NOT NULL").select(F.concat(F.lit("chapters/"), "chapter_id", F.lit(".txt")).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return op.payload_hashes(files)


@query("""
SELECT coalesce(b.id, a.id) AS path, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT id, min(content_hash) AS h FROM {kb_chapters} GROUP BY id) b FULL OUTER JOIN (SELECT chapter_id AS id, min(sha256(content)) AS h FROM {kb_texts} GROUP BY chapter_id) a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.h IS DISTINCT FROM b.h""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, U6"""
    before = view(spark, sf_dir, "kb_chapters").groupBy(F.col("id").alias("path")).agg(F.min("content_hash").alias("sha256"))
    after = view(spark, sf_dir, "kb_texts").groupBy(F.col("chapter_id").alias("path")).agg(F.min(F.sha2("content", 256)).alias("sha256"))
    return op.changed_files(before, after)


@query("""
WITH c AS (SELECT DISTINCT idx % 50 AS work_id, id, book_id, idx FROM {kb_chapters} WHERE idx IS NOT NULL AND id IS NOT NULL),
s AS (SELECT DISTINCT idx % 50 AS work_id, chapter_id, 1000 - idx AS place FROM {kb_texts} WHERE title IS NOT NULL AND idx IS NOT NULL AND chapter_id IS NOT NULL),
f AS (SELECT c.work_id, c.id, c.book_id, c.idx, min(s.place) AS place FROM c LEFT JOIN s ON s.work_id = c.work_id AND s.chapter_id = c.id GROUP BY ALL)
SELECT work_id, id AS chapter_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY place NULLS LAST, book_id NULLS FIRST, idx, id) - 1 AS INT) AS pos FROM f""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, J18, W7"""
    work = (F.col("idx") % 50).alias("work_id")
    chapters = view(spark, sf_dir, "kb_chapters", "idx IS NOT NULL AND id IS NOT NULL").select(work, "id", "book_id", "idx")
    stated = view(spark, sf_dir, "kb_texts", "title IS NOT NULL AND idx IS NOT NULL AND chapter_id IS NOT NULL").select(work, "chapter_id", (1000 - F.col("idx")).alias("place"))
    return op.reading_order(stated, chapters)


@query()
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24"""
    return view(spark, sf_dir, "events").select("event_id", op.canonical_json_udf("props").alias("canonical"))




def _escaped(name: str):
    return F.replace(F.replace(F.col(name), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias(name)


def _pages(spark: SparkSession, sf_dir: str, escaped: bool = False) -> DataFrame:
    blank = F.lit("")
    texts = view(spark, sf_dir, "kb_texts", "chapter_id IS NOT NULL")
    if escaped:
        texts = texts.select("chapter_id", _escaped("title"), _escaped("content"))
    html = F.concat(F.lit("<html><style>p {{</style><h1>"), F.coalesce("title", blank), F.lit('</h1><a href="https://books.example/'), "chapter_id", F.lit('">'), F.coalesce("title", blank), F.lit('</a><a href="">none</a><a href="/n"> Next  page </a><p>'), F.replace(F.coalesce("content", blank), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></html>"))
    return texts.select(F.col("chapter_id").alias("page_id"), "title", "content", html.alias("html"))


@query(r"""
SELECT page_id, CASE WHEN length(t) > 300 THEN concat(substr(t, 1, 300), '...') ELSE t END AS text, length(t) > 300 AS truncated FROM (
  SELECT chapter_id AS page_id, trim(regexp_replace(concat_ws(' ', coalesce(title, ''), coalesce(title, ''), 'none Next page', coalesce(content, '')), '[\s\x0b\x85\pZ]+', ' ', 'g'), ' ') AS t FROM {kb_texts} WHERE chapter_id IS NOT NULL AND NOT contains(concat(coalesce(title, ''), coalesce(content, '')), '<') AND NOT contains(coalesce(content, ''), '&'))""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, S19, F25; the SQL leaves out texts that hold markup themselves"""
    t = web.page_text(F.col("html"), 300)
    return _pages(spark, sf_dir, escaped=True).select("page_id", t["text"].alias("text"), t["truncated"].alias("truncated"))


@query(r"""
SELECT chapter_id AS page_id, 0 AS n, concat('https://books.example/', chapter_id) AS href, substr(trim(regexp_replace(title, '[\s\x0b\x85\pZ]+', ' ', 'g'), ' '), 1, 100) AS text FROM {kb_texts} WHERE chapter_id IS NOT NULL AND trim(regexp_replace(coalesce(title, ''), '[\s\x0b\x85\pZ]+', ' ', 'g'), ' ') <> ''
UNION ALL SELECT chapter_id, 2, '/n', 'Next page' FROM {kb_texts} WHERE chapter_id IS NOT NULL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2"""
    return web.links(_pages(spark, sf_dir))


@query(r"""
WITH pieces AS (SELECT page_id, k, p FROM (SELECT chapter_id AS page_id, unnest(range(5)) AS k, unnest([coalesce(title, ''), coalesce(title, ''), 'none', ' Next  page ', '']) AS p FROM {kb_texts} WHERE chapter_id IS NOT NULL)
  UNION ALL SELECT chapter_id, 10 + unnest(range(len(l))), unnest(l) FROM (SELECT chapter_id, string_split(coalesce(content, ''), chr(10)) AS l FROM {kb_texts} WHERE chapter_id IS NOT NULL)),
hits AS (SELECT page_id, k, trim(regexp_replace(p, '[\s\x0b\x85\pZ]+', ' ', 'g'), ' ') AS t FROM pieces)
SELECT page_id, CAST(n - 1 AS INT) AS n, substr(t, 1, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n FROM hits WHERE contains(lower(t), 'the')) WHERE n <= 5""")
def page_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3"""
    return web.keyword_hits(_pages(spark, sf_dir), "the")


# A page of results for every chapter: two headed results by chapter, a list only, or bare links
_SQUASHED = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x0b\x85\pZ]+', ' ', 'g'), ' ')"
_PAGES = f"""(SELECT chapter_id AS page_id, coalesce(idx, 0) % 3 AS kind, concat('https://books.example/', chapter_id) AS url, {_SQUASHED.format("replace(replace(title, '&', ' '), '<', ' ')")} AS title, {_SQUASHED.format("replace(replace(content, '&', ' '), '<', ' ')")} AS body FROM {{kb_texts}} WHERE chapter_id IS NOT NULL)"""


def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: F.coalesce(F.translate(c, "&<", "  "), F.lit(""))
    texts = view(spark, sf_dir, "kb_texts", "chapter_id IS NOT NULL")
    kind, title, url = F.coalesce("idx", F.lit(0)) % 3, clean("title"), F.concat(F.lit("https://books.example/"), "chapter_id")
    link = lambda u, t: F.concat(F.lit('<a class="r" href="'), u, F.lit('">'), t, F.lit("</a>"))
    own = F.lit('<a href="https://www.bing.com/search?q=x">More results of this kind</a>')
    second = link(F.concat(url, F.lit("/2")), F.lit("A second result"))
    headed = F.concat(F.lit("<h2>"), own, F.lit("</h2><li><h2>"), link(url, title), F.lit("</h2><div></div><p>"), clean("content"), F.lit("</p></li><li><h2>"), second, F.lit("</h2></li><li><h2>"), link(url, F.lit("The same once more")), F.lit("</h2></li>"))
    listed = F.concat(own, F.lit("<ol><li>"), link(url, title), F.lit("</li><li>"), second, F.lit("</li></ol>"), link(F.lit("https://other.example/"), F.lit("Outside of the list")))
    html = F.concat(F.lit("<html><body>"), F.when(kind == 0, headed).when(kind == 1, listed).otherwise(F.concat(link(url, title), own)), F.lit("</body></html>"))
    return texts.select(F.col("chapter_id").alias("page_id"), html.alias("html"))


@query(f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS n, url, substr(title, 1, 150) AS title, substr(snippet, 1, 300) AS snippet FROM (
  SELECT page_id, 1 AS o, url, title, CASE WHEN kind = 0 THEN body ELSE '' END AS snippet FROM {_PAGES} WHERE length(title) >= 6
  UNION ALL SELECT page_id, 2, concat(url, '/2'), 'A second result', '' FROM {_PAGES} WHERE kind < 2
  UNION ALL SELECT page_id, 3, url, 'The same once more', '' FROM {_PAGES} WHERE kind = 0 AND length(title) < 6)""")
def page_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By headings with snippets, by a list, or by all links of a page"""
    return web.search_results(_result_pages(spark, sf_dir))


@query(f"""
SELECT page_id, CASE WHEN length(title) >= 6 THEN concat(url, '/2') ELSE url END AS url, CASE WHEN length(title) >= 6 THEN 'A second result' ELSE 'The same once more' END AS title FROM {_PAGES} WHERE kind = 0""")
def page_second_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second result of every page that has one"""
    return web.nth_result(_result_pages(spark, sf_dir), 2)


@query(f"""
SELECT page_id, CASE WHEN length(title) > 15 OR kind = 2 THEN url ELSE concat(url, '/2') END AS url, CASE WHEN length(title) > 15 OR kind = 2 THEN substr(title, 1, 120) ELSE 'A second result' END AS title FROM {_PAGES} WHERE kind > 0
UNION ALL SELECT page_id, url, CASE WHEN length(title) >= 18 THEN substr(title, 1, 120) ELSE 'The same once more' END FROM {_PAGES} WHERE kind = 0""")
def page_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the links whose target names books the one with the longest text"""
    return web.best_link(_result_pages(spark, sf_dir), "books .example")
