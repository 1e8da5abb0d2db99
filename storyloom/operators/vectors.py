"""Vectors: validated upserts, exact and approximate nearest neighbours, hash embeddings, incremental embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.prefix import running
from storyloom.functions.text import content_hash
from storyloom.session import shuffle_width, written

#: Vectors in a block that is multiplied at once, and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 512
#: Vectors in a block of the exact search, blocks sent to Python at once, pairs whose exact distances are reckoned at once, what float products may be off by.
NEAR_BLOCK, BLOCKS_SENT, PAIRS, ALLOWANCE = 2048, 4, 4096, 1e-5
#: Places of features that are remembered at once.
KNOWN = 200_000
DIMENSIONS = 384
_TOKENS = re.compile(r"[一-鿿]|[a-z0-9_]+")


def storable(vector: Column) -> Column:
    """Not empty, every value a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def valid(vector: Column) -> Column:
    """Storable and not all zero, so that it has a direction."""
    return storable(vector) & F.exists(vector, lambda x: x != 0)


def _packed(rows: DataFrame, block: int, code: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (id bigint, dims, vector) in blocks (dims int, ids binary, data binary) of at most `block` rows of one dimension, as floats or as `code` makes of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat, offsets = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32), batch.column(2).offsets.to_numpy()
            starts = offsets[:-1] - offsets[0]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i in range(0, len(at), block):
                    part = at[i : i + block]
                    data = flat[starts[part][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([ids[part].astype(np.int64).tobytes()], pa.binary()), pa.array([(code(data) if code else data).tobytes()], pa.binary())], ["dims", "ids", "data"])

    return rows.mapInArrow(pack, "dims int, ids binary, data binary")


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _better(best: tuple, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple:
    """best: (query numbers, distances, ids) of the k nearest so far of each of the unit rows q, by query, distance and id; with those of the unit rows v, called ids, among them.

    What may be among the k nearest is told by float products, less an allowance for their error; its distances are exact.
    """
    near = q.astype(np.float32) @ v.astype(np.float32).T
    held = np.bincount(best[0], minlength=len(q))
    ends = np.cumsum(held)
    full = held >= k
    least = np.full(len(q), -np.inf)
    least[full] = 1 - best[1][ends[full] - 1] - ALLOWANCE
    if len(ids) > k and not full.all():
        least[~full] = np.partition(near[~full], len(ids) - k, axis=1)[:, len(ids) - k] - ALLOWANCE
    rows, cols = np.nonzero(near >= least[:, None])
    exact = np.empty(len(rows))
    for i in range(0, len(rows), PAIRS):
        at = slice(i, i + PAIRS)
        exact[at] = 1 - np.clip(np.einsum("ij,ij->i", q[rows[at]], v[cols[at]]), -1, 1)
    rows, exact, found = (np.concatenate(x) for x in zip(best, (rows, exact, ids[cols])))
    order = np.lexsort((found, exact, rows))
    rows, exact, found = rows[order], exact[order], found[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    keep = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows))) < k
    return rows[keep], exact[keep], found[keep]


def _query_blocks(queries: DataFrame) -> tuple[DataFrame, list[int]]:
    """(blocks (q, q_dims, q_ids, q_data) numbered from 0, one number a block); they are fixed in a written table, so that their copies agree."""
    q = written(_packed(queries, QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id()), "queries")
    numbers = [r["q"] for r in q.select("q").collect()]  # one number for QUERY_BLOCK queries
    if not numbers:
        return q, numbers
    numbered = q.withColumn("q", F.array_position(F.array(*map(F.lit, numbers)), F.col("q")).cast("int") - 1)
    return numbered.select("q", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), numbers


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by cosine of every query, among all vectors of its dimension; ties by id.

    queries and vectors: (id bigint, vector array<float>). Invalid vectors take no part. Both sides are packed in blocks and written; each task reads some of either
    (a Cartesian product, so nothing is copied into an exchange), and only the best k of a block of queries among its vectors leave it. A few blocks at a time are sent to Python.
    """
    spark = vectors.sparkSession
    prep = lambda df: df.where(valid(F.col("vector"))).select(F.col("id").cast("bigint"), F.size("vector").alias("dims"), "vector")
    q = written(_packed(prep(queries), QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id()), "queries").select("q", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    v = written(_packed(prep(vectors), NEAR_BLOCK), "vectors")
    pairs = q.join(v.hint("shuffle_replicate_nl"), F.col("dims") == F.col("q_dims")).select("q", "dims", "q_ids", "q_data", "ids", "data")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, asked, best = None, None, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "vec_id", "distance"])
        for batch in batches:
            for i in range(batch.num_rows):
                number, d = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if number != now:
                    if now is not None:
                        yield out()
                    now, q_ids = number, np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                    asked = _unit(np.frombuffer(batch.column(3)[i].as_py(), np.float32).reshape(-1, d))
                    best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                ids, data = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((4, np.int64), (5, np.float32)))
                best = _better(best, asked, ids, _unit(data.reshape(-1, d)), k)
        if now is not None:
            yield out()

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BLOCKS_SENT))
    try:
        hits = written(pairs.mapInArrow(match, "query_id bigint, vec_id bigint, distance double"), "near")
    finally:
        spark.conf.set(key, before)
    return _top(hits, k)


def _top(hits: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def _codes(rows: np.ndarray) -> np.ndarray:
    """Unit rows as 4-bit codes, two to a byte: every component in 15 steps over 2.5 times the size that the components of a unit row have on average. Nothing is fitted."""
    d = rows.shape[1]
    steps = (np.clip(np.rint(_unit(rows) * (d**0.5 * 7 / 2.5)), -7, 7) + 8).astype(np.uint8)
    if d % 2:
        steps = np.concatenate([steps, np.full((len(steps), 1), 8, np.uint8)], 1)
    return steps[:, ::2] << 4 | steps[:, 1::2]


def _steps(codes: np.ndarray, d: int) -> np.ndarray:
    out = np.empty((len(codes), 2 * codes.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = codes >> 4, codes & 15
    return out[:, :d] - 8


def nearest_by_codes(queries: DataFrame, vectors: DataFrame, k: int, keep: int = 5) -> DataFrame:
    """As nearest(), approximately: an index of 4-bit codes of all vectors, an eighth of their size, is searched whole, and the keep * k best of each query are ranked anew by their exact distance.

    Cells are no help where vectors lie in all directions alike: to reach nine of ten neighbours there most cells have to be read. Codes keep the order of distances well in any
    data, need no sample and no fit, and the search is one matrix product a block.
    """
    width = shuffle_width(vectors.sparkSession)
    prep = lambda df: df.where(valid(F.col("vector"))).select(F.col("id").cast("bigint"), F.size("vector").alias("dims"), "vector")
    q, numbers = _query_blocks(prep(queries))
    if not numbers:
        return nearest(queries, vectors, k)
    v = _packed(prep(vectors), BLOCK, _codes).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(len(numbers) - 1))))
    pairs = v.join(q, "q").where("dims = q_dims").select("dims", "q_ids", "q_data", "ids", "data")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, q_ids, q_data, ids, data = (batch.column(c)[i].as_py() for c in range(5))
                asked, known = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                steps = _steps(np.frombuffer(data, np.uint8).reshape(len(known), -1), d)
                near = _unit(np.frombuffer(q_data, np.float32).reshape(-1, d)).astype(np.float32) @ (steps / np.maximum(np.linalg.norm(steps, axis=1, keepdims=True), 1e-9)).T
                n = min(keep * k, len(known))
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(known[best].ravel()), pa.array(-np.take_along_axis(near, best, 1).ravel().astype(np.float64))], ["query_id", "vec_id", "distance"])

    found = _top(pairs.repartition(width).mapInArrow(match, "query_id bigint, vec_id bigint, distance double"), keep * k).select("query_id", "vec_id")
    of = lambda df, key, name: df.where(valid(F.col("vector"))).select(F.col("id").cast("bigint").alias(key), F.col("vector").alias(name))
    both = found.join(of(vectors, "vec_id", "_v"), "vec_id").join(of(queries, "query_id", "_q"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("_q", "_v") / F.sqrt(dot("_q", "_q") * dot("_v", "_v"))
    return _top(both.select("query_id", "vec_id", (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("distance")), k)


def hash_embeddings(texts: list[str], dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """Words, ideographs and their runs of two and three, each adding 1 or -1 at a place given by its hash; unit length. A text without any is the zero vector. The places of up to KNOWN features, and a text's, are remembered, so that a frequent one is hashed once."""
    known: dict[str, int] = {}

    def place(feature: str) -> int:  # twice the place, and one more for -1
        digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        return known.setdefault(feature, 2 * (int.from_bytes(digest[:4], "little") % dimensions) + digest[4] % 2)

    out = []
    for text in texts:
        if len(known) > KNOWN:
            known.clear()
        tokens = _TOKENS.findall((text or "").lower())
        features = [*tokens, *map("".join, zip(tokens, tokens[1:])), *map("".join, zip(tokens, tokens[1:], tokens[2:]))]
        at = np.array([known[f] if f in known else place(f) for f in features], np.int64)
        vector = np.bincount(at >> 1, 1.0 - 2 * (at & 1), dimensions).astype(np.float32) if len(at) else np.zeros(dimensions, np.float32)
        norm = np.linalg.norm(vector)
        out.append(vector / norm if norm else vector)
    return out


def hash_embedding(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    return hash_embeddings([text], dimensions)[0]


#: The backend that is always there; others are given as functions of a list of texts.
HASH_BACKEND = f"hash{DIMENSIONS}"


def answered(results: list[dict]) -> list[list[float]]:
    """Vectors of an embedding service's answer ({index, embedding}), in the order asked for, whatever order they came in; a gap or repeat raises."""
    ordered = sorted(results, key=lambda r: r["index"])
    if [r["index"] for r in ordered] != list(range(len(ordered))):
        raise ValueError("an answer is missing or given twice")
    return [r["embedding"] for r in ordered]


class Backend:
    """A model backend for `embedded`, made once in a worker by `make`; where that fails, or fails twice for a batch, the hash embedding stands in from then on."""

    def __init__(self, make: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> None:
        self.make, self.batch, self.embed = make, batch, None

    def __getstate__(self):
        return self.make, self.batch

    def __setstate__(self, state):
        self.__init__(*state)

    def __call__(self, texts: list[str]) -> list:
        out: list = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            for last in (False, True):
                try:
                    self.embed = self.embed or self.make()
                    out += self.embed(part)
                    break
                except Exception:  # noqa: BLE001  a backend may fail in any way
                    if last:
                        self.embed = hash_embeddings
                        return hash_embeddings(texts)  # all of one kind
        return out


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[np.ndarray]] | None = None) -> DataFrame:
    """chunks (id, text) -> (id, vector), in batches; embed is a backend for a list of texts, by default the hash embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if not embed:
                for i in range(0, len(texts), 1024):
                    flat = np.concatenate(hash_embeddings(texts[i : i + 1024]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIMENSIONS), pa.int32()), pa.array(flat, pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1024), lists], ["id", "vector"])
                continue
            vectors = embed(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() if hasattr(v, "tolist") else v for v in vectors], pa.list_(pa.float32()))], ["id", "vector"])

    return chunks.select("id", "text").mapInArrow(run, "id string, vector array<float>")


def pruned(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored vectors whose chunk is no longer expected."""
    return stored.join(expected.select("id").distinct(), "id", "left_anti")


#: Facts of an entity in one chunk; those of a hot entity make several.
PART_FACTS = 200


def chunk_texts(kb: dict[str, DataFrame], chapter: str | None = None) -> DataFrame:
    """(id, book_id, source_type, source_id, text, content_hash) of what is embedded of kb (chapters, entities, mentions, events, foreshadowing, rules), by one builder for whole books and single chapters.

    Done chapters with a summary; entities with their facts in order of chapter, without any they have no chunk; events; hints; rules. The facts of an entity are cut into chunks of
    PART_FACTS, so that none outgrows a record: the first is called ent_<id>, the next ent_<id>_1 and so on. chapter: only what belongs to it - its summary, entities first seen there, its events, hints
    planted and rules first seen there.
    """
    own = lambda name, column: kb[name] if chapter is None else kb[name].where(F.col(column) == chapter)
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = lambda label, c: F.when(s(c) != "", F.concat(F.lit(f" {label}: "), c)).otherwise("")
    chunk = lambda rows, prefix, kind, text, *more: rows.select(F.concat(F.lit(prefix), "id", *more).alias("id"), "book_id", F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), text.alias("text"))
    at = kb["chapters"].select(F.col("id").alias("chapter_id"), "idx", F.col("title").alias("chapter_title"))
    heads = own("entities", "first_chapter_id").select("id", "book_id", F.concat(F.lit("实体: "), s("canonical_name"), F.lit(" ("), s("type"), F.lit(")\n")).alias("head"))
    facts = kb["mentions"].join(heads.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(at, "chapter_id", "left")
    facts = facts.select("entity_id", "idx", "id", F.concat(F.lit("- ["), F.coalesce("chapter_title", F.lit("?")), F.lit("] "), s("fact"), F.lit("\n")).alias("line"))
    facts = running(facts, ["entity_id"], [F.col("idx"), F.col("id")], {}).withColumn("part", F.floor((F.col("rank") - 1) / PART_FACTS).cast("int"))
    parts = facts.groupBy(F.col("entity_id").alias("id"), "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "").alias("lines"))
    entities = heads.join(parts, "id")
    placed = kb["chapters"].select(F.col("id").alias("chapter_id"), "book_id", "idx")
    events = own("events", "chapter_id").join(placed, ["chapter_id", "book_id"], "left")
    event = F.concat(F.lit("事件: 第"), F.coalesce(F.col("idx").cast("string"), F.lit("?")), F.lit("章 "), s("who"), F.lit(" "), s("what"), said("地点", "where_loc"), said("原因", "why"), said("结果", "consequence"), said("时间", "story_time"))
    hint = F.concat(F.when(F.col("status") == "open", "伏笔 [未解]: ").otherwise("伏笔 [已解]: "), s("hint"), F.when(s("resolution") != "", F.concat(F.lit(" → 回收: "), "resolution")).otherwise(""))
    chunks = [
        chunk(own("chapters", "id").where("status = 'done' AND coalesce(summary, '') <> ''"), "ch_summary_", "chapter_summary", F.concat(F.lit("章节: "), s("title"), F.lit("\n"), "summary")),
        chunk(entities, "ent_", "entity", F.concat("head", "lines"), F.when(F.col("part") > 0, F.concat(F.lit("_"), F.col("part").cast("string"))).otherwise("")),
        chunk(events, "ev_", "event", event), chunk(own("foreshadowing", "hint_chapter_id"), "fs_", "foreshadowing", hint),
        chunk(own("rules", "first_chapter_id"), "rule_", "rule", F.concat(F.lit("规则: "), s("name"), F.lit(": "), s("body"))),
    ]
    return reduce(DataFrame.union, chunks).withColumn("content_hash", content_hash(F.col("text")))


def refreshed(chunks: DataFrame, registry: DataFrame, vectors: DataFrame, backend_id: str = HASH_BACKEND, embed: Callable[[list[str]], list] | None = None, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vectors, registry) after the chunks (chunk_texts()) that changed were embedded.

    registry: (id, content_hash, backend_id); vectors: (id, vector). A chunk registered with its hash by this backend is left alone, any other is embedded, put in the place of its old vector and
    registered; vectors that can't be stored are refused and not registered. With prune, vectors of chunks that are no longer there go, and all of another
    backend with them, as their chunks are embedded anew; without it (one chapter's chunks) they stay.
    """
    stamped = chunks.withColumn("backend_id", F.lit(backend_id))
    fresh = stamped.join(registry, ["id", "content_hash", "backend_id"], "left_anti")
    made = embedded(fresh, embed).where(storable(F.col("vector")))
    kept = vectors.join(fresh.select("id"), "id", "left_anti")
    known = registry.join(fresh.select("id"), "id", "left_anti")
    if prune:
        kept, known = (rows.join(chunks.select("id"), "id", "left_semi") for rows in (kept, known))
    entries = fresh.join(made.select("id"), "id", "left_semi").select("id", "content_hash", "backend_id")
    return kept.select("id", "vector").unionByName(made), known.select(entries.columns).unionByName(entries)


def entity_of(chunk_id: Column) -> Column:
    """The entity a chunk id stands for, null for other chunks."""
    return F.nullif(F.regexp_extract(chunk_id, r"^ent_(.*?)(?:_\d{1,9})?$", 1), F.lit(""))
