"""Cases that whole tables don't show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from storyloom.functions import json, text
from storyloom.functions.prefix import running
from storyloom.operators import changes, context, governance, ingest, lookups, pages, provenance, timeline, vectors
from storyloom.operators.graph import connected_components
from storyloom.operators.predicates import metadata_matches, types_compatible


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "normal"),
    [("ＡＢＣ", "abc"), ("  Ａ b", "a b"), ("《 阿Q 》", "《阿q》"), ("（ x ）", "(x)"), (None, None), ("É", "É"), ("", "")],
)
def test_normal_name(name, normal):
    assert text.normal_name(name) == normal


@pytest.mark.parametrize(("name", "initial"), [("阿", "A"), ("张三", "Z"), ("bob", "B"), ("9", "9"), ("*", "#"), ("", "#"), (None, "#"), ("泠", "#")])
def test_initial(name, initial):
    assert text.initial(name) == initial


def test_types(spark):
    pairs = [
        ("地点", "场所", True), ("人物", "地点", False), (None, "人物", True), ("宗门", "宗门", True), ("宗门", "人物", False), ("", "人物", True), ("x", "人物", False), ("x", "未知", True), (None, None, True), ("势力", "阵营", True),
        ("人物", "事件", False), ("人物", "规则", False), ("功法", "境界", False), ("人物", "主角", False), ("物品", "道具", True), ("规则", "设定", True), ("x", "x", True), ("未分类", "事件", True),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert rows.where(types_compatible(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_metadata_trees(spark):
    meta = F.create_map(F.lit("a"), F.lit("1"))
    holds = lambda where: value(spark, metadata_matches(where, meta))
    assert holds({}) and holds({"a": 1}) and holds({"b": {"$ne": 1}}) and holds({"b": None}) and holds({"a": {"$in": [1, 2]}, "b": {"$nin": [3]}})
    assert holds({"$or": [{"a": 1}], "b": 2}) and holds({"$and": []})
    assert not holds("text") and not holds({"a": 2}) and not holds({"$or": []}) and not holds({"b": {"$in": [1]}})
    assert holds({"a": {"$gt": 1}}) and holds("") and holds(None) and not holds({"$and": {"a": 1}})  # an unknown operator asks for nothing


def test_json(spark):
    of = lambda t: value(spark, json.recovered(F.lit(t), "none"))
    assert [of('```json\n{"a": 1}\n```'), of("see {1} or [2]"), of("so: [1, 2] end"), of(""), of("x")] == ['{"a": 1}', "[2]", "[1, 2]", "none", "none"]
    assert value(spark, json.array_text(F.lit('[{"a": 1}, {"b": '))) == '[{"a": 1}]'
    assert [value(spark, json.aliases(F.lit(x))) for x in ("null", "", "bad", '["a","a"," b "]')] == [[], [], [], ["a", "b"]]


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc") if rng.random() < 0.9 else None, i, rng.randrange(9)) for i in range(700)]
    got = running(spark.createDataFrame(rows, "g string, i int, n int").repartition(5), ["g"], [F.col("i")], {"s": F.col("n")}).collect()
    assert len(got) == 700
    for g in {r[0] for r in rows}:
        own, total = sorted(r for r in rows if r[0] == g), 0
        for place, (_, i, n) in enumerate(own, 1):
            total += n
            r = next(r for r in got if r.g == g and r.i == i)
            assert (r["rank"], r.s) == (place, total)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_spans(spark):
    rows = spark.createDataFrame([("x", 0, 10), ("x", 85, 90), ("x", 171, 180), ("y", 5, 6)], "k string, start bigint, end bigint")
    got = {(r.k, r.start, r.end) for r in timeline.merged_spans(rows, "k", 80).collect()}
    assert got == {("x", 0, 90), ("x", 171, 180), ("y", 5, 6)}


def test_packing_of_blocks(spark):
    rows = spark.createDataFrame([("b", i, s) for i, s in enumerate((5, 5, 7, 1))], "g string, i int, size int")
    assert {r.i for r in context.packed_blocks(rows, "g", [F.col("i")], 10).collect()} == {0, 1}
    assert {r.i for r in context.packed_blocks(rows, "g", [F.col("i")], 4).collect()} == set()
    assert sorted((r.i, r.kept) for r in context.cut_blocks(rows, "g", [F.col("i")], 13, 6).collect()) == [(0, 5), (1, 5), (2, 3)]


def test_facts_around(spark):
    rng = random.Random(3)
    facts = [(f"f{i:03}", f"e{rng.randrange(4)}", f"c{(c := rng.randrange(12)):02}", c) for i in range(300)]
    df = spark.createDataFrame(facts, "id string, entity_id string, chapter_id string, idx int")
    for limit in (1, 3, 15):
        before, other = {}, {}
        for _, e, c, idx in facts:
            own = sorted((f for f in facts if f[1] == e), key=lambda f: (f[3], f[2], f[0]))
            before[e, c] = {f[0] for f in [f for f in own if f[3] < idx][-limit:]}
            other[e, c] = {f[0] for f in [f for f in own if f[2] != c][:limit]}
        for got, want in ((lookups.recent_before(df, limit), before), (lookups.elsewhere(df, limit), other)):
            assert {(r.entity_id, r.chapter_id, r.mention_id) for r in got.collect()} == {(*k, m) for k, ids in want.items() for m in ids}


def _container(n, spoil=lambda events: None, manifest='{"format_name": "work", "format_version": "2"}'):
    """(manifest, history lines, files) of n events, spoilt before the lines are written."""
    import json

    files = [("a.txt", "h1", 3), ("b.txt", "h2", 4)]
    events, last = [], ""
    for i in range(n):
        e = {"author": "me", "changed_files": [{"path": p, "sha256": s, "size": z} for p, s, z in files], "previous_event_hash": last, "n": i}
        last = provenance.event_hash(e)
        events.append(e | {"event_hash": last})
    spoil(events)
    return manifest, [json.dumps(e, ensure_ascii=False) for e in events], files


def test_verified(spark):
    def relinked(events):
        events[3]["previous_event_hash"] = "elsewhere"
        events[3]["event_hash"] = provenance.event_hash(events[3])

    def nobody(events):
        events[4]["author"] = " "
        events[4]["event_hash"] = provenance.event_hash(events[4])

    def other_files(events):
        events[4]["changed_files"].pop()
        events[4]["event_hash"] = provenance.event_hash(events[4])

    cases = {
        "good": (_container(5), (True, None, None)), "flip": (_container(5, lambda e: e[2].__setitem__("n", 9)), (False, "bad_event_hash", 2)), "link": (_container(5, relinked), (False, "broken_link", 3)),
        "nobody": (_container(5, nobody), (False, "no_author", 4)), "files": (_container(5, other_files), (False, "files_differ", 4)), "none": (_container(0), (False, "no_history", None)),
        "blank": (_container(2, manifest=None), (False, "no_manifest", None)), "text": (_container(2, manifest="{"), (False, "no_manifest", None)), "format": (_container(2, manifest='{"format_version": 2}'), (False, "wrong_format", None)),
        "old": (_container(2, manifest='{"format_name": "work", "format_version": 1}'), (False, "unsupported_version", None)),
    }
    works = spark.createDataFrame([(k, c[0][0]) for k, c in cases.items()], "work_id string, manifest string")
    history = spark.createDataFrame([(k, i, line) for k, c in cases.items() for i, line in enumerate(c[0][1])] + [("broken", 0, "no json")], "work_id string, pos int, line string")
    files = spark.createDataFrame([(k, *f) for k, c in cases.items() for f in c[0][2]], "work_id string, path string, sha256 string, size int")
    got = {r.work_id: (r.ok, r.reason, r.pos) for r in provenance.verified(works.union(spark.createDataFrame([("broken", cases["good"][0][0])], works.schema)), history, files).collect()}
    assert got == {k: c[1] for k, c in cases.items()} | {"broken": (False, "bad_event_hash", 0)}
    assert provenance.canonical_json('{"b": 1.50, "a": "é"}') == '{"a":"é","b":1.5}'
    assert provenance.canonical_json("x") is None
    assert not provenance.safe_member("../x") and not provenance.safe_member("/x") and provenance.safe_member("a/../b")


def test_identity(tmp_path):
    path = str(tmp_path / "me.json")
    made = provenance.identity(path, "Ann")
    assert made["user_name"] == "Ann" and provenance.identity(path) == made and provenance.identity(path, "Bo")["client_id"] == made["client_id"]
    (tmp_path / "me.json").write_text("broken")
    assert provenance.identity(path)["user_name"]


def test_upsert_keeps_on_null(spark):
    old = spark.createDataFrame([("a", "t", "done"), ("b", None, "done")], "id string, title string, status string")
    new = spark.createDataFrame([("a", None), ("c", "")], "id string, title string")
    got = {tuple(r) for r in changes.upserted(old, new, ["id"], {"status": "pending"}).collect()}
    assert got == {("a", "t", "done"), ("b", None, "done"), ("c", "", "pending")}


def test_queue_goes_round(spark):
    log = [(1, "a", "enqueue"), (2, "a", "claim"), (3, "a", "done"), (4, "a", "enqueue"), (5, "b", "enqueue"), (6, "b", "error"), (7, "c", "done")]
    state = changes.queue_state(spark.createDataFrame(log, "id int, key string, action string"))
    assert {(r.key, r.status, r.attempts) for r in state.collect()} == {("a", "pending", 0), ("b", "error", 1)}
    assert [r.key for r in changes.claimed(state, 5).collect()] == ["a"]


def test_pages(spark):
    html = "<a href='x'></a>" * 19 + "<a href='y'>Yes &amp; no</a><a href='z'>late</a><script>hidden</script><p>one</p>"
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    assert [(r.href, r.text) for r in pages.links(df).collect()] == [("y", "Yes & no")]
    assert [r.text for r in pages.keyword_hits(df, "ONE").collect()] == ["one"]
    got = {r.page_id: r.t.text for r in df.select("page_id", pages.page_text(F.col("html"), 8).alias("t")).collect()}
    assert got == {1: "Yes & no...", 2: "", 3: None}


def _brute(q, v, k):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    return np.argsort(1 - unit(q) @ unit(v).T, axis=1, kind="stable")[:, :k]


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = (centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.4, size=(600, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000, [0.0] * 16), (1001, [float("nan")] * 16), (1002, [1.0, 2.0]), (1003, None), (1004, [])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    queries = df.where("id % 50 = 0 AND id < 600")
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    want = _brute(data[::50], data, 10)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(queries, df, 10).collect()}
    assert got == {(50 * i, j + 1): int(want[i, j]) for i in range(12) for j in range(10)}
    near = vectors.nearest_by_codes(queries, df, 10).collect()
    hits = sum(r.vec_id in want[r.query_id // 50] for r in near)
    assert hits / 120 >= 0.9
    assert vectors.nearest(df.where("id < 0"), df, 3).count() == 0


def test_recall_of_codes_on_test_data(spark):
    from storyloom.plans.vectors import _vectors

    rows = _vectors(spark, "/root/testdata/sf0.01").drop("label")
    key = lambda f: {(r.query_id, r.vec_id) for r in f(rows.where("id % 50 = 0"), rows, 10).collect()}
    want = key(vectors.nearest)
    assert len(want & key(vectors.nearest_by_codes)) / len(want) >= 0.97


def test_codes():
    rows = np.random.default_rng(1).normal(size=(5, 7)).astype(np.float32)
    steps = vectors._steps(vectors._codes(rows), 7)
    assert steps.shape == (5, 7) and np.abs(steps).max() <= 7
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.abs(np.clip(unit * (7**0.5 * 7 / 2.5), -7, 7) - steps).max() <= 0.5 + 1e-5


def test_hash_embedding():
    v = vectors.hash_embedding("洛阳 city city")
    assert v.shape == (384,) and abs(np.linalg.norm(v) - 1) < 1e-5
    assert not vectors.hash_embedding("").any() and not vectors.hash_embedding(None).any()


def test_names_in_texts(spark):
    names = spark.createDataFrame([("b", "e1", "Rose"), ("b", "e2", "玫瑰"), ("b", "e3", " "), ("c", "e4", "rose"), ("b", "e5", None)], "book_id string, entity_id string, name string")
    texts = spark.createDataFrame([("b", "t1", "the ROSE and 玫瑰"), ("b", "t2", None), ("b", "t3", ""), ("d", "t4", "rose")], "book_id string, text_id string, text string")
    assert {tuple(r) for r in lookups.names_in_texts(names, texts).collect()} == {("t1", "e1"), ("t1", "e2")}


def test_passages():
    from storyloom.operators.passages import FALLBACK, focus_passages

    body = "\n".join(f"line {i} " + "x" * 400 for i in range(20))
    assert focus_passages(None, ["a"], 10) == "" and focus_passages("abcdef", None, 3) == "def" and focus_passages("abc", ["zz"], 80) == "zz" + FALLBACK + "abc"
    blank = "a" * 400 + "\n\n" + "b" * 200 + "\nmark\n" + "c" * 200 + "\n\n" + "d" * 400
    assert focus_passages(blank, ["mark"], 10_000) == blank[401 - 300 : 402 + 200 + 6 + 200 + 300].strip()  # from blank line to blank line
    two = focus_passages(body, ["line 3 ", "line 17 "], 10_000)
    assert two.count("---") == 1 and "line 3 " in two and "line 17 " in two and "line 10 " not in two
    assert "line 5" in focus_passages(body, ["line\n5"], 10_000)


def test_aligned(spark):
    chapters = spark.createDataFrame([("x", 0, 4, "c4"), ("x", 1, 5, "c5"), ("y", 0, 4, "d4"), ("y", 1, 5, "d5")], "batch string, place int, idx int, chapter_id string")
    results = spark.createDataFrame([("x", 0, 9, "a"), ("x", 1, 9, "b"), ("y", 0, 5, "b"), ("z", 0, 0, "lost")], "batch string, place int, chapter_idx int, result string")
    assert {tuple(r) for r in governance.aligned(results, chapters).collect()} == {("x", "c4", "a"), ("x", "c5", "b"), ("y", "d5", "b")}


def test_merges_are_followed(spark):
    m = lambda rows: spark.createDataFrame(rows, "from_id string, into_id string")
    got = {tuple(r) for r in changes.followed(m([(f"e{i}", f"e{i - 1}") for i in range(1, 20)] + [("x", "y"), ("x", "a"), ("z", "z")])).collect()}
    assert got == {(f"e{i}", "e0") for i in range(1, 20)} | {("x", "a")}
    assert changes.followed(m([])).count() == 0
    with pytest.raises(ValueError):
        changes.followed(m([("a", "b"), ("b", "a")]))


def test_shared_folder_and_clean_up(spark, tmp_path):
    from storyloom import session

    with pytest.raises(RuntimeError):
        session._own_dir("spark://host:7077")
    with pytest.raises(RuntimeError):
        session._own_dir("local-cluster[2,1,1024]")
    kept = session.written(spark.range(3), "kept")
    import os

    folder = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    done = connected_components(edges, "a", "b")
    assert done.count() == 31 and len(set(os.listdir(folder)) - before) == 1  # its result only
    session.forget(kept)
    assert len(set(os.listdir(folder)) - before) == 1 and len(before - set(os.listdir(folder))) == 1
    session.forget(spark.range(1))


def test_resolution(spark):
    """Steps in order, types, aliases in order, names new in one batch that are one."""
    entities = spark.createDataFrame(
        [("e1", "b", "Ann", "人物", ["Annie"], None, ""), ("e2", "b", "Annie", "地点", [], "c0", "kept"), ("e3", "b", "Bo", "势力", ["B"], "c0", None), ("e4", "b2", "Ann", "人物", None, None, None)],
        "id string, book_id string, canonical_name string, type string, aliases array<string>, first_chapter_id string, name_norm string",
    )
    said = [
        ("c1", 1, "Ann", "地点", ["Nan"]), ("c1", 1, "ＡＮＮ", "人物", []), ("c1", 1, "annie", "人物", ["x"]), ("c1", 1, "b", "物品", []), ("c1", 1, "Cy", "人物", ["Cyrus", "Cy", " "]), ("c2", 2, "cy", "未知", []), ("c2", 2, "CY", "地点", []), ("c2", 2, " ", "人物", []), ("c2", 2, "Ann", "人物", ["Nan", "Anna"]),
    ]
    rows = [("b", c, i, {"entities": [{"canonical_name": n, "type": t, "aliases_in_chapter": a, "facts": []} for x, y, n, t, a in said if x == c]}) for c, i in (("c1", 1), ("c2", 2))]
    import json as j

    results = ingest.parsed(spark.createDataFrame([(b, c, i, j.dumps(r)) for b, c, i, r in rows] + [("b", "c3", 3, "no json"), ("b", "c4", 4, None)], "book_id string, chapter_id string, idx int, result string"))
    found = ingest.resolved(ingest.names_of(results), entities, ingest.alias_rows(entities))
    got = {r.name: (r.how, r.entity_id if r.how != "new" else r.called) for r in found.collect()}
    assert got == {"Ann": ("exact", "e1"), "ＡＮＮ": ("alias", "e1"), "annie": ("alias", "e1"), "b": ("new", "b"), "Cy": ("new", "Cy"), "cy": ("new", "Cy"), "CY": ("new", "CY")}
    after = {r.canonical_name: (r.aliases, r.first_chapter_id, r.name_norm) for r in ingest.entities_after(entities, found).where("book_id = 'b'").collect()}
    assert after["Ann"] == (["Annie", "Nan", "Anna", "x"], "c1", "ann") and after["Annie"] == ([], "c0", "kept") and after["Cy"][0] == ["Cyrus", "cy"] and after["CY"] == ([], "c2", "cy")


def test_snippets_of_loose_json(spark):
    of = lambda t: value(spark, json.loose_text(F.lit(t)))
    assert [of(t) for t in ('["a", null, "", 0, "b"]', "null", '"x"', "7", '{"a": 1}', "", "bad", None)] == ["a, b", "", "x", "7", '{"a": 1}', "", "", ""]


def test_failing_backends(spark):
    calls = []

    def make():
        def embed(texts):
            calls.append(len(texts))
            if "bad" in texts:
                raise RuntimeError
            return [[1.0, 2.0]] * len(texts)

        return embed

    backend = vectors.Backend(make, 2)
    assert backend(["a", "b", "c"]) == [[1.0, 2.0]] * 3 and calls == [2, 1]
    assert len(backend(["a", "bad"])[0]) == 384 and len(backend(["a"])[0]) == 384  # from then on
    assert vectors.answered([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]) == [[1], [2]]
    with pytest.raises(ValueError):
        vectors.answered([{"index": 1, "embedding": [2]}])


def test_chunks_of_a_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_FACTS", 10)
    empty = lambda ddl: spark.createDataFrame([], ddl)
    kb = {
        "chapters": spark.createDataFrame([("c", "b", 1, "T", "s", "done"), ("d", "b", 2, None, "s", "pending")], "id string, book_id string, idx int, title string, summary string, status string"),
        "entities": spark.createDataFrame([("e", "b", "N", None, "c"), ("f", "b", "M", "t", "c")], "id string, book_id string, canonical_name string, type string, first_chapter_id string"),
        "mentions": spark.createDataFrame([(f"m{i:02}", "e", "c" if i % 2 else "gone", f"f{i}") for i in range(25)], "id string, entity_id string, chapter_id string, fact string"),
        "events": empty("id string, book_id string, chapter_id string, story_time string, who string, what string, where_loc string, why string, consequence string"),
        "foreshadowing": empty("id string, book_id string, hint_chapter_id string, hint string, status string, resolution string"), "rules": empty("id string, book_id string, first_chapter_id string, name string, body string"),
    }
    got = {r.id: r.text for r in vectors.chunk_texts(kb).collect()}
    assert set(got) == {"ch_summary_c", "ent_e", "ent_e_1", "ent_e_2"} and got["ch_summary_c"] == "章节: T\ns" and got["ent_e"].startswith("实体: N ()\n- [?] f0\n- [?] f2\n") and got["ent_e_2"].count("\n") == 6
    ids = spark.createDataFrame([(i,) for i in got], "id string")
    assert {r.e for r in ids.select(vectors.entity_of(F.col("id")).alias("e")).collect()} == {None, "e"}
    assert {r.id for r in vectors.chunk_texts(kb, "d").collect()} == set()


def test_changed_files(spark):
    before = spark.createDataFrame([("same", "1"), ("gone", "1"), ("null", "1"), ("other", "1")], "path string, sha256 string")
    after = spark.createDataFrame([("same", "1"), ("new", None), ("null", None), ("other", "2")], "path string, sha256 string")
    assert {tuple(r) for r in provenance.changed_files(before, after).collect()} == {("gone", "removed"), ("new", "added"), ("null", "modified"), ("other", "modified")}
