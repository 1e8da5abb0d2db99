import random

from storyloom.llm import near_duplicates as nd

SCHEMA = "id string, fact string, norm string, rid int"


def brute(rows, threshold=0.6):
    texts = {i: nd.comparable(t) for i, t, *_ in rows if i is not None and t is not None}
    texts = {i: t for i, t in texts.items() if len(t) >= nd.LEAST_LENGTH}
    return {(a, b) for a in texts for b in texts if a < b and nd.hamming_within(texts[a], texts[b], threshold)}


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randrange(1, 5)):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[at] = rng.choice("甲乙丙丁abc")
        elif rng.random() < 0.5:
            out.insert(at, rng.choice("戊己xyz"))
        else:
            del out[at]
    if rng.random() < 0.3:
        cut = rng.randrange(len(out))
        out = out[cut:] + out[:cut]
    return "".join(out)


def data(n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        base = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(25, 70))) if i % 3 else " ".join(rng.choice(["road", "stone", "harbour", "winter", "mirror", "lantern", "oath"]) + str(rng.randrange(90)) for _ in range(9))
        rows += [(f"{i:03}-{j}", base if j == 0 else edited(rng, base), "clash", 7) for j in range(rng.randrange(1, 4))]
    return rows


def test_pairs_against_brute_force(spark):
    rows = data()
    rows += [("copy-1", rows[0][1], None, None), ("copy-1", rows[0][1], None, None), ("null", None, None, None), ("", "", None, None), ("short", "too short", None, None), (None, rows[0][1], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs({"t": (df, "id", "fact")}).collect()}
    want = brute(rows)
    assert not got - want
    assert len(want - got) <= 0.01 * len(want)
    assert any("copy-1" in p for p in got)


def test_tables_stay_apart(spark):
    df = spark.createDataFrame(data(10)[:1], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicate_pairs({"a": (df, "id", "fact"), "b": (df, "id", "fact"), "c": (empty, "id", "fact")}).count() == 0
    assert nd.near_duplicate_pairs({"c": (empty, "id", "fact")}).count() == 0


def test_groups(spark):
    rows = data(40)
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {r.id: (r.class_id, r.links) for r in nd.near_duplicate_groups({"t": (df, "id", "fact")}).collect()}
    assert set(groups) == {r[0] for r in rows if len(nd.comparable(r[1])) >= nd.LEAST_LENGTH}
    for a, b in brute(rows):
        assert groups[a][0] == groups[b][0]
    assert all(c <= i for i, (c, _) in groups.items())


def test_very_long_text(spark):
    long = "".join(chr(0x4E00 + i % 5000) for i in range(200_000))
    df = spark.createDataFrame([("a", long, None, None), ("b", long + "尾", None, None), ("c", long[::-1], None, None)], SCHEMA)
    assert {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs({"t": (df, "id", "fact")}).collect()} == {("a", "b")}


def test_threshold_is_the_hamming_bound():
    a, b = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrst"
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    assert nd.hamming_within(a, b, len(x & y) / len(x | y)) and not nd.hamming_within(a, b, len(x & y) / len(x | y) + 0.01)


def test_comparable():
    assert nd.comparable("Ａ-b c！ é２") == "abcé2" and nd.comparable(None) is None


def test_group_of_edits_that_is_a_third_of_the_table(spark):
    rng = random.Random(5)
    text = lambda: [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60)]
    base, rows = text(), []
    for i in range(300):
        out = list(base)
        for at in rng.sample(range(60), rng.choice((2, 3))):
            out[at] = chr(rng.randrange(0x4E00, 0x9000))
        rows.append((f"e{i:03}", "".join(out), None, None))
    rows += [(f"o{i:03}", "".join(text()), None, None) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs({"t": (df, "id", "fact")}).collect()}
    want = brute(rows)
    assert len(want) > 10_000
    assert not got - want
    assert len(want - got) <= 0.01 * len(want), f"{len(want - got)} of {len(want)} lost"
    classes = {r.id: r.class_id for r in nd.near_duplicate_groups({"t": (df, "id", "fact")}).collect()}
    assert {classes[f"e{i:03}"] for i in range(300)} == {"e000"}


def test_chance_pairs_of_one_kind_do_not_leave_their_blocks(spark):
    rng = random.Random(8)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    stock = [text(14) for _ in range(12)]  # any two texts share about a quarter of their runs
    texts = ["".join(rng.sample(stock, 3)) + text(24) for _ in range(400)]
    texts += [t[:-2] + text(2) for t in texts[:40]]
    rows = [(0, i, t, nd.signs(*nd.runs([t]), 1)[0].tolist()) for i, t in enumerate(texts)]
    got = [(r.rid_a, r.rid_b) for r in nd.candidates(spark.createDataFrame(rows, "src_no int, rid bigint, norm string, signs array<bigint>")).collect()]
    assert len(got) == len(set(got)) and {(i, 400 + i) for i in range(40)} <= set(got)
    assert all(nd.hamming_within(texts[a], texts[b], 0.2) for a, b in got)


def test_an_id_of_several_texts_gives_a_pair_once(spark):
    rows = data(1)[:1]
    text = rows[0][1]
    rows = [(i, t, None, None) for i, t in (("a", text), ("a", text + "尾"), ("b", text), ("b", text + "尾"), ("c", text))]
    got = sorted((r.id_a, r.id_b) for r in nd.near_duplicate_pairs({"t": (spark.createDataFrame(rows, SCHEMA), "id", "fact")}).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
