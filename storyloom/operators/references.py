"""References to records that do not exist.

Keys are spread over ranges of their 64-bit hash. For each range the parents are held
as arrays sorted by hash; reference rows stream past them in Arrow batches and are
looked up by binary search, with the key strings compared on a hit, so a hash
collision never counts as a match. Each reference row is shuffled once.

A range that holds a hot key is split: the rows of every range are counted first (one
number per range comes to the driver), and a range with more than twice its share
is dealt over several tasks, each with a copy of the range's parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import key_form
from storyloom.session import shuffle_width

MISSING, DELETED, LATE = "missing", "deleted", "late"
#: Most parents in one range; each is held as about 100 bytes in a worker.
PARENTS_A_RANGE = 500_000
#: Ranges with fewer reference rows are never split.
LEAST_SPLIT = 50_000


@dataclass(frozen=True)
class Reference:
    """A field of a table that names a record of another."""

    table: str
    field: str
    rows: DataFrame
    target: str
    made: str  # column with the epoch seconds that give the month
    record_id: str = "id"
    arrived: str = "arrived_at"


def _micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def parents_of(targets: dict[str, tuple[DataFrame, str, str]], deletions: DataFrame) -> DataFrame:
    """(target, key, first_arrival, deleted) of every record that is there; deleted if its latest entry in deletions says so."""
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("target"), key_form(F.col(key)).alias("key"), _micros(F.col(at)).alias("at")) for name, (df, key, at) in targets.items()])
    rows = rows.where(F.col("key").isNotNull()).groupBy("target", "key").agg(F.min("at").alias("first_arrival"))
    latest = (
        deletions.select(F.col("table_name").alias("target"), key_form(F.col("record_id")).alias("key"), "action", F.struct("logged_at", "id").alias("entry"))
        .where(F.col("target").isin(*targets) & F.col("key").isNotNull())
        .groupBy("target", "key")
        .agg(F.max_by("action", "entry").alias("action"))
    )
    return rows.join(latest.where("action = 'delete'").select("target", "key", F.lit(True).alias("deleted")), ["target", "key"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, is_ref, hash): the parents of a bucket, then the references to be looked up among them."""
    now, held, table = None, [], None
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        refs = batch.column("is_ref").to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((np.diff(buckets, prepend=buckets[:1] - 1) != 0) | (np.diff(refs.astype(np.int8), prepend=-1) != 0))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            if buckets[a] != now:
                now, held, table = buckets[a], [], None
            if not refs[a]:
                held.append(part.select(["hash", "key", "at", "deleted"]))
                continue
            if table is None:
                table = pa.Table.from_batches(held).combine_chunks() if held else False
            out = _misses(part, table)
            if out.num_rows:
                yield out


def _misses(refs: pa.RecordBatch, parents) -> pa.RecordBatch:
    n = refs.num_rows
    reason = np.full(n, MISSING, object)
    if parents is not False:
        hashes, wanted = parents.column("hash").to_numpy(), refs.column("hash").to_numpy()
        at = np.searchsorted(hashes, wanted)
        keys, places = parents.column("key").combine_chunks(), np.full(n, -1)
        left = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == wanted))
        while len(left):  # more than once only where different keys have one hash
            same = pc.equal(keys.take(pa.array(at[left])), refs.column("key").take(pa.array(left))).to_numpy(zero_copy_only=False).astype(bool)
            places[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(hashes)]
            left = left[hashes[at[left]] == wanted[left]]
        hit = np.flatnonzero(places >= 0)
        there = parents.take(pa.array(places[hit]))
        first, came = there.column("at"), refs.column("at").take(pa.array(hit))
        late = pc.fill_null(pc.greater(first, came), False).to_numpy(zero_copy_only=False).astype(bool)
        gone = there.column("deleted").to_numpy().astype(bool)
        reason[hit] = np.where(gone, DELETED, np.where(late, LATE, None))
    bad = pa.array(np.flatnonzero(np.not_equal(reason, None)))
    return pa.RecordBatch.from_arrays([refs.column("ref").take(bad), refs.column("record_id").take(bad), refs.column("made").take(bad), pa.array(reason).take(bad).cast(pa.string())], ["ref", "record_id", "made", "reason"])


def dangling_references(references: list[Reference], targets: dict[str, tuple[DataFrame, str, str]], deletions: DataFrame) -> DataFrame:
    """(ref_table, ref_field, record_id, month, reason), one row per dangling reference.

    A null or blank key is no reference. reason is 'missing' if the target has no such
    key, 'deleted' if its latest deletion entry (ties: the larger entry id) is a
    deletion, else 'late' if the target's earliest arrival is after the record's. A
    null arrival is never late. A record without an id is kept under a null record_id.
    Redelivered rows are compared one by one and reported once: the earliest of them is
    late exactly if any is. An empty target makes every reference to it missing.
    """
    spark = deletions.sparkSession
    width = shuffle_width(spark)
    parents = parents_of(targets, deletions)
    held = sum(df.count() for df, *_ in targets.values())  # from the Parquet footers
    ranges = max(4 * width, -(-held // PARENTS_A_RANGE))
    hashed = lambda target: F.xxhash64(target, F.col("key"))
    ranged = (F.shiftrightunsigned("hash", 40) * ranges / F.lit(1 << 24)).cast("int")

    def keyed(i: int, r: Reference, *also: Column) -> DataFrame:
        rows = r.rows.select(key_form(F.col(r.field)).alias("key"), *also).where(F.col("key").isNotNull())
        return rows.withColumn("ref", F.lit(i)).withColumn("hash", hashed(F.lit(r.target))).withColumn("range", ranged)

    counts = {r["range"]: r["n"] for r in reduce(DataFrame.unionAll, [keyed(i, r) for i, r in enumerate(references)]).groupBy("range").agg(F.count("*").alias("n")).collect()}
    share = max(LEAST_SPLIT, 2 * sum(counts.values()) // ranges)
    splits = F.create_map(*(x for k, n in counts.items() if n > share for x in (F.lit(k), F.lit(-(-n // share))))) if max(counts.values(), default=0) > share else None
    split = F.lit(1) if splits is None else F.coalesce(splits[F.col("range")], F.lit(1))
    most = F.lit(max(1, *(-(-n // share) for n in counts.values())) if counts else 1)

    columns = ["bucket", "is_ref", "hash", "key", "ref", "record_id", "at", "deleted", "made"]
    rows = reduce(DataFrame.unionAll, [keyed(i, r, F.col(r.record_id).cast("string").alias("record_id"), _micros(F.col(r.arrived)).alias("at"), F.col(r.made).cast("bigint").alias("made")) for i, r in enumerate(references)])
    rows = rows.withColumns({"bucket": F.col("range") * most + F.pmod(F.xxhash64("record_id", "at"), split).cast("int"), "is_ref": F.lit(True), "deleted": F.lit(False)}).select(columns)
    there = parents.withColumn("hash", hashed(F.col("target"))).withColumn("range", ranged).withColumn("copy", F.explode(F.sequence(F.lit(0), split - 1)))
    there = there.select((F.col("range") * most + F.col("copy")).cast("int").alias("bucket"), F.lit(False).alias("is_ref"), "hash", "key", F.lit(0).alias("ref"), F.lit(None).cast("string").alias("record_id"), F.col("first_arrival").alias("at"), "deleted", F.lit(None).cast("bigint").alias("made"))
    probed = rows.unionAll(there.select(columns)).repartition(width, "bucket").sortWithinPartitions("bucket", "is_ref", "hash").mapInArrow(_probe, "ref int, record_id string, made bigint, reason string")
    names = F.element_at(F.array(*(F.struct(F.lit(r.table).alias("t"), F.lit(r.field).alias("f")) for r in references)), F.col("ref") + 1)
    month = F.date_format(F.timestamp_add("SECOND", F.col("made"), F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM")
    return probed.select(names["t"].alias("ref_table"), names["f"].alias("ref_field"), "record_id", month.alias("month"), "reason").distinct()


def dangling_report(found: DataFrame) -> DataFrame:
    """Dangling references counted by table, field, month and reason."""
    return found.groupBy("ref_table", "ref_field", "month", "reason").agg(F.count("*").alias("refs"))
