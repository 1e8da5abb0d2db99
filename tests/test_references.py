import datetime

from storyloom.operators.references import Reference, dangling_references, dangling_report

ENTITY = "id string, first string, made bigint, arrived_at timestamp_ntz, hash string"
DELETION = "id bigint, table_name string, record_id string, action string, logged_at bigint"
DAY = lambda n: datetime.datetime(2025, 1, n)


def found(spark, refs, parents, deletions):
    r = spark.createDataFrame(refs, ENTITY)
    p = spark.createDataFrame(parents, "id string, arrived_at timestamp_ntz, range string")
    d = spark.createDataFrame(deletions, DELETION)
    return dangling_references([Reference("refs", "first", r, "parents", "made")], {"parents": (p, "id", "arrived_at")}, d)


def test_reasons(spark):
    refs = [
        ("a", "P1", 0, DAY(2), "x"), ("b", " p1　", 0, DAY(2), "x"), ("c", "p2", 0, DAY(1), "x"), ("d", "p3", 2_678_400, DAY(5), "x"), ("e", "gone", 0, DAY(5), None),
        ("f", None, 0, DAY(5), "x"), ("g", " ", 0, DAY(5), "x"), ("a", "P1", 0, DAY(9), "x"), ("h", "p4", None, None, "x"), ("c", "p2", 0, DAY(8), "x"),
    ]
    parents = [("p1", DAY(1), "r"), ("P1 ", DAY(3), "r"), ("p2", DAY(4), "r"), ("p3", DAY(1), "r"), ("p4", None, "r"), (None, DAY(1), "r")]
    deletions = [(1, "parents", "P3", "restore", 5), (2, "parents", "p3", "delete", 5), (3, "parents", "p1", "delete", 1), (4, "parents", "p1", "restore", 2), (5, "other", "p4", "delete", 9), (6, None, None, None, None)]
    rows = {(r.record_id, r.month, r.reason) for r in found(spark, refs, parents, deletions).collect()}
    assert rows == {("c", "1970-01", "late"), ("d", "1970-02", "deleted"), ("e", "1970-01", "missing")}


def test_empty_tables(spark):
    assert found(spark, [], [("p", DAY(1), "r")], []).count() == 0
    missing = found(spark, [("a", "p", 0, DAY(1), "x")], [], [])
    assert [r.reason for r in missing.collect()] == ["missing"]
    assert dangling_report(missing).first().refs == 1


def test_hot_key_is_split_and_whole(spark, monkeypatch):
    import storyloom.operators.references as m

    monkeypatch.setattr(m, "LEAST_SPLIT", 10)
    refs = [(f"r{i}", "hot" if i % 3 else f"k{i}", 0, DAY(1), "x") for i in range(600)]
    parents = [("hot", DAY(2), "r")] + [(f"k{i}", DAY(1), "r") for i in range(0, 600, 6)]
    rows = found(spark, refs, parents, []).collect()
    assert len(rows) == 400 + 100
    assert sum(r.reason == "late" for r in rows) == 400
