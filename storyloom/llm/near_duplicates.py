"""Records that say nearly the same: pigeonhole blocks over set fingerprints.

A text is compared as the set of its runs of three characters. Two sets have an
intersection of at least t times their union exactly if the Hamming distance of
their indicator vectors is at most (1 - t) / (1 + t) of the sum of their sizes, so
the similarity bound is a Hamming bound.

1. Equal texts are reduced to one row first (one hash aggregation).
2. A text's fingerprint is a row of BLOCKS * ROWS symbols, each the least of its
   runs under another hash. It is cut into BLOCKS blocks; texts that differ in
   fewer than BLOCKS symbols must have a block in common (pigeonhole), and texts
   that differ in more of them share one with probability 1 - (1 - s**ROWS)**BLOCKS
   at similarity s. All runs take part, so this holds however large a group of near
   texts is or however many texts share a run.
3. The blocks are taken PASS at a time, so that only the keys of so many lie on disk at once. Keys travel as
   packed arrays, one array for each batch and key range, so the exchange carries no row overhead. Each range is
   sorted in numpy; equal keys give candidate pairs, in bounded batches.
   Every entry carries the SIGN bits of its text's own fingerprint (one bit of each of SIGN other minimum hashes). A pair of
   similarity s differs in a bit with probability (1 - s) / 2; pairs that differ in more of them than most_differing()
   permits never leave the task. Texts of one kind share blocks by chance, so such pairs grow with the square of the texts.
4. Each distinct candidate pair is verified by the Hamming distance of the whole indicator vectors, on the whole texts, which is exact.

A 64-bit SimHash can't be used at similarity 0.6: such pairs differ in about 15 of
64 bits, which leaves blocks of 2 to 4 bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from storyloom.session import forget, shuffle_width, written

THRESHOLD = 0.6
LEAST_LENGTH = 20
ROWS, BLOCKS = 5, 56
#: Blocks whose keys are exchanged at once.
PASS = 8
#: Bits of a text's own fingerprint, and its bytes.
SIGN = 256
SIGN_BYTES = SIGN // 8
#: Texts in a fingerprint matrix; candidate pairs in an emitted batch.
LANES, EMIT = 512, 200_000
#: Characters of the texts whose runs are compared at once.
PIECE_CHARS = 2_000_000
#: Entries of a key range, so that chance matches of the 24 key bits that travel stay few for each entry.
RANGE_ENTRIES = 50_000
_NOT_WORD = re.compile(r"[\W_]+")


def comparable(text: str | None) -> str | None:
    """NFKC, lower case, letters and digits only; None stays None."""
    if text is None:
        return None
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _NOT_WORD.sub("", text.lower())


@pandas_udf(StringType())
def comparable_udf(texts):
    return texts.map(comparable, na_action="ignore")


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct three-character runs of each text as mixed 32-bit hashes: (text number, hash), sorted by both."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    mixed = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.zeros(len(points), bool)
    ends = np.cumsum(lengths)
    inside[:] = True
    for back in (1, 2):
        at = ends[lengths >= back] - back
        inside[at] = False
    inside = inside[:-2]
    both = np.sort((owner[:-2][inside].astype(np.uint64) << np.uint64(32)) | (mixed[inside] >> np.uint64(32)))
    both = both[np.diff(both, prepend=~both[:1]) != 0]
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def most_differing(bits: int, threshold: float) -> int:
    """In how many bits of minimum hashes a pair at the threshold may differ: each differs with probability (1 - threshold) / 2; 4.2 standard deviations over the mean."""
    p = (1 - threshold) / 2
    return int(bits * p + 4.2 * (bits * p * (1 - p)) ** 0.5)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1 << 20, 1 << 32, ROWS * BLOCKS, dtype=np.uint32) | np.uint32(1)


def block_keys(owner: np.ndarray, hashes: np.ndarray, count: int, multipliers: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have any run, their keys as uint64 [text, block]) of the blocks from number `first` on that the multipliers, ROWS for each block, make."""
    sizes = np.bincount(owner, minlength=count)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    order = some[np.argsort(sizes[some], kind="stable")]
    blocks = len(multipliers) // ROWS
    keys = np.empty((len(order), blocks), np.uint64)
    least = np.empty((ROWS * blocks, LANES), np.uint32)
    for at in range(0, len(order), LANES):
        docs = order[at : at + LANES]
        depth = np.arange(sizes[docs].max())[:, None]
        matrix = hashes[starts[docs][None, :] + np.minimum(depth, sizes[docs][None, :] - 1)]
        scratch, width = np.empty_like(matrix), len(docs)
        for k, by in enumerate(multipliers):
            np.multiply(matrix, by, out=scratch)
            np.min(scratch, axis=0, out=least[k, :width])
        parts = least[:, :width].reshape(blocks, ROWS, width).astype(np.uint64)
        key = np.repeat(np.arange(first + 1, first + blocks + 1, dtype=np.uint64)[:, None], width, 1)
        for r in range(ROWS):
            key ^= parts[:, r]
            key *= np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        keys[at : at + width] = key.T
    return order, keys


def signs(owner: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """SIGN bits of every text as int64 [text, word], one of each of SIGN minimum hashes; 0 for a text without runs."""
    multipliers = np.random.default_rng(20250311).integers(1 << 20, 1 << 32, SIGN, dtype=np.uint32) | np.uint32(1)
    sizes = np.bincount(owner, minlength=count)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    order = some[np.argsort(sizes[some], kind="stable")]
    out = np.zeros((count, SIGN // 64), np.int64)
    bits = np.empty((SIGN, LANES), np.uint8)
    for at in range(0, len(order), LANES):
        docs = order[at : at + LANES]
        depth = np.arange(sizes[docs].max())[:, None]
        matrix = hashes[starts[docs][None, :] + np.minimum(depth, sizes[docs][None, :] - 1)]
        scratch = np.empty_like(matrix)
        for k, by in enumerate(multipliers):
            np.multiply(matrix, by, out=scratch)
            bits[k, : len(docs)] = (scratch.min(0) >> np.uint32(12)) & np.uint32(1)
        out[docs] = np.ascontiguousarray(np.packbits(bits[:, : len(docs)], axis=0).T).view(np.int64)
    return out


@pandas_udf(ArrayType(LongType()))
def signs_udf(texts):
    import pandas as pd

    out = []
    for i in range(0, len(texts), 1 << 13):
        part = texts.iloc[i : i + (1 << 13)].tolist()
        out += list(signs(*runs(part), len(part)))
    return pd.Series(out, dtype=object)


def candidates(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (rid_a, rid_b) of the rows of reps (src_no int, rid bigint, norm string, signs array<bigint>) that share a block and whose signs are near enough for the threshold. rid must be durable."""
    passes = [_written_once(_sharing(reps, first, min(first + PASS, BLOCKS), threshold).distinct(), "blocked") for first in range(0, BLOCKS, PASS)]
    found = _written_once(reduce(DataFrame.unionAll, passes).distinct(), "candidates")
    for one in passes:
        forget(one)
    return found


def _sharing(reps: DataFrame, first: int, end: int, threshold: float) -> DataFrame:
    """Pairs (rid_a, rid_b), with repeats, that share one of the blocks from `first` to before `end`, as candidates() gives them."""
    spark = reps.sparkSession
    width, most = shuffle_width(spark), most_differing(SIGN, threshold)
    blocks = end - first
    ranges = max(width, reps.count() * blocks // RANGE_ENTRIES)  # counted in the Parquet footers

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()[first * ROWS : end * ROWS]
        for batch in batches:
            for piece in (batch.slice(i, 1 << 15) for i in range(0, batch.num_rows, 1 << 15)):
                yield from pack_piece(piece, multipliers)

    def pack_piece(batch, multipliers) -> Iterator[pa.RecordBatch]:
        sources = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        rids = batch.column(1).to_numpy(zero_copy_only=False)
        own = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIGN // 64)
        docs, key = block_keys(*runs(batch.column(2).to_pylist()), len(rids), multipliers, first)
        key ^= (sources[docs] * np.uint64(2))[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        key *= np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(31)
        at, key = np.repeat(docs, blocks), key.ravel()
        to = ((key >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, at, key = to[order], at[order], key[order]
        doc, low, high = at.astype(np.uint16), key.astype(np.uint16), (key >> np.uint64(16)).astype(np.uint8)
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        # the rids of a batch are a few rising stretches: their starts stand for all of them
        breaks = np.flatnonzero(np.diff(rids, prepend=rids[:1] - 2) != 1)
        head = np.array([len(breaks)], np.int64).tobytes() + breaks.astype(np.int64).tobytes() + rids[breaks].astype(np.int64).tobytes()
        blobs = [head + own[at[a:b]].tobytes() + low[a:b].tobytes() + doc[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(to)))]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["key_range", "entries"])

    def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        breaks, firsts = np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n)
        at = 8 + 16 * n
        m = (len(blob) - at) // (SIGN_BYTES + 5)
        own = np.frombuffer(blob, np.uint64, m * SIGN // 64, at).reshape(m, SIGN // 64)
        at += m * SIGN_BYTES
        low, doc, high = np.frombuffer(blob, np.uint16, m, at), np.frombuffer(blob, np.uint16, m, at + 2 * m).astype(np.int64), np.frombuffer(blob, np.uint8, m, at + 4 * m)
        key = low | (high.astype(np.uint32) << np.uint32(16))
        stretch = np.searchsorted(breaks, doc, "right") - 1
        return key, firsts[stretch] + doc - breaks[stretch], own

    def match(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, rid, own = (np.concatenate(p) for p in zip(*map(unpack, blobs)))
        order = np.argsort(key, kind="stable")
        key, rid, own = key[order], rid[order], own[order]
        at = np.flatnonzero(key[1:] == key[:-1])
        step = 1
        while len(at):  # all entries of a run against the entry `step` further on
            for i in range(0, len(at), EMIT):
                one = at[i : i + EMIT]
                one = one[np.bitwise_count(own[one] ^ own[one + step]).sum(1, dtype=np.int64) <= most]
                a, b = rid[one], rid[one + step]
                low, high = np.minimum(a, b), np.maximum(a, b)
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(low[low != high]), pa.array(high[low != high])], ["rid_a", "rid_b"])
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if to != now:
                    if held:
                        yield from match(held)
                    now, held = to, []
                held.append(blob.as_py())
        if held:
            yield from match(held)

    packed = reps.select("src_no", "rid", "norm", "signs").mapInArrow(pack, "key_range int, entries binary")
    return packed.repartition(width, "key_range").sortWithinPartitions("key_range").mapInArrow(join, "rid_a bigint, rid_b bigint")


def hamming_within(a: str, b: str, threshold: float) -> bool:
    """Whether the indicator vectors of the three-character runs of a and b are close enough for the threshold."""
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _perhaps_within(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Whether pairs of texts are worth an exact comparison, by the hashes of their runs. These may collide, hence the slack."""
    x, y = ((owner.astype(np.uint64) << np.uint64(32)) | hashes for owner, hashes in (runs(a), runs(b)))
    both = np.sort(np.concatenate([x, y]))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
    sizes = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(a))
    return shared >= (threshold - 0.05) * (sizes - shared)


def _verified(threshold: float):
    @pandas_udf(BooleanType())
    def verified(a, b):
        import pandas as pd

        a, b = a.tolist(), b.tolist()
        piece = np.cumsum([len(x) + len(y) for x, y in zip(a, b)]) // PIECE_CHARS
        cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)).tolist()
        perhaps = [p for i, j in zip(cuts, cuts[1:]) for p in _perhaps_within(a[i:j], b[i:j], threshold).tolist()]
        return pd.Series([p and hamming_within(x, y, threshold) for x, y, p in zip(a, b, perhaps)], dtype=bool)

    return verified


def _sources(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows (src_no, id, norm) of all tables {name: (table, id column, text column)}."""
    parts = [
        df.select(F.lit(i).alias("src_no"), F.col(key).alias("id"), comparable_udf(F.col(text)).alias("norm")).where(F.col("id").isNotNull())
        for i, (df, key, text) in enumerate(tables.values())
    ]
    rows = reduce(DataFrame.unionAll, parts).where(F.length("norm") >= LEAST_LENGTH)
    return rows


def _written_once(df: DataFrame, name: str) -> DataFrame:
    """As written, for a df that isn't used again: its shuffle files go as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def _hashed(rows: DataFrame) -> DataFrame:
    """With 128 bits that stand for the text of its table."""
    return rows.withColumns({"h1": F.xxhash64("src_no", "norm"), "h2": F.xxhash64(F.lit(71), "norm")})


def _near(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(one row per different text, pairs of the different texts that are near), by rid."""
    own = F.xxhash64("id")
    reps = rows.groupBy("src_no", "norm").agg((F.min(own) != F.max(own)).alias("copied"))
    reps = _written_once(_hashed(reps).withColumns({"rid": F.monotonically_increasing_id(), "signs": signs_udf("norm")}), "texts")
    of = lambda c, x: reps.select(F.col("rid").alias(f"rid_{x}"), F.col(c).alias(f"{c}_{x}"))
    found = candidates(reps, threshold)
    pairs = found.join(of("norm", "a"), "rid_a").join(of("norm", "b"), "rid_b").where(_verified(threshold)("norm_a", "norm_b")).select("rid_a", "rid_b")
    near = _written_once(pairs, "near_texts")
    forget(found)
    return reps, near


def near_duplicate_pairs(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(src_table, id_a, id_b), id_a < id_b: records of one table whose texts are at least `threshold` similar.

    Null texts and texts under LEAST_LENGTH characters after normalising take no part;
    rows without an id neither. A repeated row counts once. Records with equal texts
    under different ids are pairs. Empty tables give no rows; other columns are ignored.
    """
    rows = _sources(tables)
    reps, near = _near(rows, threshold)
    keys = ("src_no", "h1", "h2")
    known = reps.select("rid", *keys)
    a, b = (known.select(F.col("rid").alias(f"rid_{x}"), *(F.col(k).alias(f"{k}_{x}") for k in keys)) for x in "ab")
    pairs = near.join(a, "rid_a").join(b, "rid_b")
    copied = reps.where("copied").select(*keys)
    wanted = reduce(DataFrame.unionAll, [pairs.select(*(F.col(f"{k}_{x}").alias(k) for k in keys)) for x in "ab"] + [copied]).distinct()
    kept = written(_hashed(rows).select("id", *keys).join(wanted, list(keys), "left_semi").distinct(), "members")
    again = kept.groupBy("src_no", "id").agg(F.count("*").alias("n")).where("n > 1").select("src_no", "id", F.lit(True).alias("again"))
    members = kept.join(again, ["src_no", "id"], "left").withColumn("again", F.coalesce("again", F.lit(False)))  # an id given to several texts
    left, right = (members.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "again", *keys))) for x in "ab")
    across = pairs.join(left, [f"{k}_a" for k in keys]).join(right, [f"{k}_b" for k in keys]).select("src_no_a", "id_a", "id_b", "again_a", "again_b")
    within = left.join(right, reduce(Column.__and__, [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys])).where("id_a < id_b").select("src_no_a", "id_a", "id_b", "again_a", "again_b")
    name = F.element_at(F.array(*map(F.lit, tables)), F.col("src_no_a") + 1)
    both = across.unionAll(within)
    named = lambda rows: rows.select(name.alias("src_table"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    # a pair comes twice only by an id that has several texts; the rest, which grows with the square of a group, needs no exchange
    return named(both.where("NOT (again_a OR again_b)")).unionAll(named(both.where("again_a OR again_b")).where("id_a <> id_b").distinct())


def near_duplicate_groups(tables: dict[str, tuple[DataFrame, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(src_table, id, class_id, links): every record that can be compared, with the least id of its class and the number of different texts near its own.

    Classes are the connected components of near texts; a record that is near no other is a class of its own. Cases are
    defined as in near_duplicate_pairs.
    """
    from storyloom.operators.graph import connected_components

    rows = _sources(tables)
    reps, near = _near(rows, threshold)
    links = near.select(F.col("rid_a").alias("rid")).union(near.select("rid_b")).groupBy("rid").agg(F.count("*").alias("links"))
    classes = connected_components(near, "rid_a", "rid_b").select(F.col("node").alias("rid"), "component")
    known = reps.join(links, "rid", "left").join(classes, "rid", "left").select("src_no", "h1", "h2", F.coalesce("component", "rid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    members = _hashed(rows).select("src_no", "h1", "h2", "id").distinct().join(known, ["src_no", "h1", "h2"])
    least = members.groupBy("component").agg(F.min("id").alias("class_id"))
    name = F.element_at(F.array(*map(F.lit, tables)), F.col("src_no") + 1)
    return members.join(least, "component").select(name.alias("src_table"), "id", "class_id", "links")
