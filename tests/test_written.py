"""What an intermediate table leaves behind."""

import time

from pyspark.sql import functions as F

from storyloom.session import written


def test_shuffle_files_go_when_the_table_is_written(spark):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    before = files()
    kept = written(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "id").groupBy("k").count(), "counts")
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.5)
    assert not files() - before
    assert kept.count() == 7 and kept.agg(F.sum("count")).first()[0] == 1000


def test_embedding_many_texts_remembers_a_bounded_number_of_features():
    import random
    import tracemalloc

    from storyloom.operators import vectors

    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500)) for _ in range(600)]
    tracemalloc.start()
    made = vectors.hash_embeddings(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6, most
    assert all((a == b).all() for a, b in zip(made[::100], (vectors.hash_embedding(t) for t in texts[::100])))


def test_nearest_in_blocks_with_ties(spark, monkeypatch):
    import numpy as np

    from storyloom.operators import vectors

    monkeypatch.setattr(vectors, "NEAR_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 6)).astype(np.float32)
    rows[200:240] = rows[7]  # equal ones: the least ids come first
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, vector array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(df.where("id % 7 = 0"), df, 5).collect()}
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    for i in range(0, 300, 7):
        distance = np.round(1 - np.clip(unit @ unit[i], -1, 1), 12)
        assert [got[i, n] for n in range(1, 6)] == np.lexsort((np.arange(300), distance))[:5].tolist()
