import pytest
from storyloom.llm import canonical_values as cv
from storyloom.llm import lookalikes as la
from storyloom.llm import names as nm

ENTITY = "id string, book_id string, canonical_name string, type string, aliases array<string>, form string"


@pytest.mark.parametrize(
    ("name", "form"),
    [("Ａｂ（１）", "Ab(1)"), ("洛‌景", "洛景"), ("⽆影", "无影"), ("é", "é"), ("　a b ", "a b"), ("①", "①"), ("陣", "陣"), ("​", ""), ("A", "A")],
)
def test_form(name, form):
    assert la.form(name) == form


def lookalikes(spark, rows):
    df = spark.createDataFrame(rows, ENTITY)
    unified = la.unified_names(la.all_names(df, "id", "canonical_name", "aliases", "book_id"))
    return unified, {(r.id_a, r.id_b) for r in la.lookalike_pairs(unified, "book_id").collect()}


def test_lookalikes(spark):
    rows = [
        ("a", "b1", "Nevtrin Kellford", "x", None, None), ("b", "b1", "Nеvtrin Kellford", "x", [], None), ("c", "b1", "nevtrin Kellford", "x", ["", None, " "], None), ("d", "b2", "Nevtrin Kellford", "x", None, None),
        ("e", "b1", "口福", "x", None, None), ("f", "b1", "ロ福", "x", ["ロ福", "ロ福"], None), ("g", "b1", "Нет", "x", None, None), ("h", "b1", "Nevtrin Kellford", "x", None, None),
        ("i", None, "口福", None, None, None), (None, "b1", "口 福", None, None, None), ("a", "b1", "Nevtrin Kellford", "x", None, None), ("j", "b1", None, None, ["工玄​"], None), ("k", "b1", "エ玄", None, None, None), ("l", "b1", "工玄", None, None, None),
        ("m", "b1", "Sіrа Qxz", None, None, None), ("n", "b1", "Sirа Qxz", None, None, None),
    ]
    unified, pairs = lookalikes(spark, rows)
    assert pairs == {("a", "b"), ("b", "h"), ("e", "f"), ("j", "k"), ("j", "l"), ("k", "l"), ("m", "n")}
    forms = {r.name: r.form for r in unified.collect()}
    assert forms["Нет"] == "Нет"  # a word of its own script stays


def test_no_names(spark):
    assert lookalikes(spark, [])[1] == set()


@pytest.fixture(scope="module")
def terms():
    codes = {"人物": "CHR", "配角": "CHR", "person": "CHR", "villain": "CHR", "地点": "LOC", "place": "LOC", "法则": "RUL", "灵宝": "RLC", "item": "ITM", "term": "CPT"}
    return cv.Terms(codes, {"item": 9})


@pytest.mark.parametrize(
    ("value", "code"),
    [
        ("人物", "CHR"), (" 人 物。", "CHR"), ("重要人物", "CHR"), ("人勿", "CHR"), ("配图", "UNMATCHED"), ("“地點”", "LOC"), ("発则", "RUL"), ("靈寶", "RLC"), ("ＰＥＲＳＯＮ", "CHR"), ("perosn", "CHR"), ("villan?", "CHR"),
        ("the place(main)", "LOC"), ("tem", "ITM"), ("weather", "UNMATCHED"), ("——", "UNMATCHED"), ("123", "UNMATCHED"), ("人物/待核", "CHR"), ("x" * 5000, "UNMATCHED"), ("pеrson", "CHR"),
    ],
)
def test_codes(terms, value, code):
    assert terms.code(value) == code


def test_lookup_equals_comparing_with_every_term(terms):
    import random

    rng = random.Random(3)
    for _ in range(400):
        word = list(rng.choice(list(terms.codes)))
        for _ in range(rng.randrange(0, 3)):
            word.insert(rng.randrange(len(word) + 1), rng.choice("aeiprs人地")) if rng.random() < 0.5 else word.pop(rng.randrange(len(word))) if word else None
        text = "".join(word)
        want = [(c, -terms.uses.get(t, 0), terms.order[t]) for t in terms.codes if (c := cv.distance(text, t)) <= min(cv.SHARE * len(t), cv.edits(t))]
        got = terms.closest(text)
        assert (got is None) == (not want) and (got is None or got[0] == min(want)[0])


def test_mapped_table(spark, terms):
    rows = [("a", "人物"), ("b", "person"), ("b", "person"), ("c", None), ("d", " "), ("e", "zzz"), (None, "地占")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, type string, type_code int")
    got = {(r.id, r.type_code) for r in cv.mapped_values(df, "id", "type", terms.codes, ["人物"]).collect()}
    assert got == {("b", "CHR"), ("e", "UNMATCHED"), (None, "LOC")}
    assert cv.mapped_values(df.where("id = 'no'"), "id", "type", terms.codes, []).count() == 0
    assert {r.type_code for r in cv.mapped_values(df, "id", "type", {}, []).collect()} == {"UNMATCHED"}


def test_a_dictionary_too_large_to_send_is_joined(spark, terms, monkeypatch):
    """The same codes by the join as by the dictionary that is sent."""
    values = ["人物", " 人 物。", "重要人物", "人勿", "配图", "“地點”", "靈寶", "perosn", "villan?", "the place(main)", "tem", "——", "人物/待核", "pеrson", "item place", "x" * 300, None, " ", "old person of place"]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, type string")
    rows = lambda: {(r.id, r.type_code) for r in cv.mapped_values(df, "id", "type", terms.codes, ["地点"]).collect()}
    sent = rows()
    monkeypatch.setattr(cv, "MOST_ENTRIES", 3)
    assert cv.Terms(terms.codes).near is None
    assert rows() == sent and len(sent) == len(values) - 2


def test_other_scripts(spark):
    """The dominant script decides, whichever it is: Cyrillic, Greek, ideographs with a letter, most letters of a word exchanged."""
    e = lambda i, n: (i, "b", n, None, None, None)
    rows = [e("a", "Москва"), e("b", "Москвa"), e("c", "Αθήνα"), e("d", "Αθήνa"), e("e", "Yarcrest"), e("f", "Үarcrest"), e("g", "生月步法A7"), e("h", "生月步法А7"), e("i", "House"), e("j", "Hоuѕе"), e("k", "Mockba"), e("l", "Anna"), e("m", "Аnna")]
    assert lookalikes(spark, rows)[1] == {("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j"), ("l", "m")}


def groups(spark, rows):
    names = spark.createDataFrame([(i, b, n) for i, b, n, _ in rows], "id string, book_id string, form string")
    kinds = spark.createDataFrame(sorted({(i, k) for i, _, _, k in rows if i}) or [("none", "other")], "id string, kind string")
    return {(r.id_a, r.id_b) for r in nm.group_pairs(nm.name_groups(names, kinds, "book_id")).collect()}


def test_names(spark):
    p, o = nm.PERSON, nm.ORGANISATION
    rows = [
        ("a", "b", "宁峰川", p), ("b", "b", "剑尊宁枫川", p), ("c", "b", "宁骁遂", p), ("d", "b", "峰川", nm.UNKNOWN), ("e", "b2", "宁峰川", p), ("f", "b", "Umaric Tarnlow", p), ("g", "b", "Tarnlow, Umaric", p), ("h", "b", "Umarric Tarnlow", p),
        ("i", "b", "U. Tarnlow", p), ("j", "b", "Halmund Tarnlow", p), ("k", "b", "蓮苍天帮", o), ("l", "b", "旧朝蓮苍的天帮", o), ("m", "b", "蓮苍天宗", o), ("n", "b", "Circle of the Patient Orchard", o), ("o", "b", "C.P.O.", o),
        ("q", "b", "宁峰川", nm.OTHER), ("r", "b", "x y z", nm.UNKNOWN), ("s", "b", "x y z", nm.UNKNOWN), (None, "b", "宁峰川", p), ("t", None, "宁峰川", p), ("a", "b", "宁峰川", p), ("u", "b", "Umaric 'x", nm.OTHER),
    ]
    got = groups(spark, rows)
    assert got == {("a", "b"), ("a", "d"), ("b", "d"), ("f", "g"), ("f", "h"), ("g", "h"), ("f", "i"), ("g", "i"), ("h", "i"), ("k", "l"), ("n", "o")}


def test_ambiguous_short_names_link_to_none(spark):
    rows = [("a", "b", "宁峰川", nm.PERSON), ("b", "b", "林峰川", nm.PERSON), ("c", "b", "峰川", nm.PERSON)]
    assert groups(spark, rows) == set()


def test_no_records(spark):
    assert groups(spark, []) == set()


def test_measures():
    assert nm.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and nm.jaro_winkler("", "a") == 0
    assert nm.within_edits("ab", "ba", 1) and not nm.within_edits("abc", "xyz", 2)
    assert nm.phonetic("kellforrd") == nm.phonetic("kellford")


def test_nicknames_from_the_table(spark):
    p = nm.PERSON
    rows = [
        ("a", "b", "William Tarnlow", p), ("b", "b", "Bill", p), ("c", "b", "Bill Tarnlow", p), ("d", "b", "Margaret Kellford", p), ("e", "b", "Peggy", p), ("f", "b", "Jennifer Ashdale", p), ("g", "b", "Jenny", p),
        ("h", "b", "Robert Belcroft", p), ("i", "b", "Gilbert Welford", p), ("j", "b", "Bert", p), ("k", "b", "Corvinna Maldane", p), ("l", "b", "Corvie", p), ("m", "b2", "Bill", p),
    ]
    assert groups(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("f", "g"), ("k", "l")}


def test_plain_pairs(spark):
    """A given name of three letters may be spelt wrongly too; ideographs that sound alike; long organisations; an organisation that lacks a character."""
    p, o = nm.PERSON, nm.ORGANISATION
    words = "Brotherhood of Silent Lantern Keepers Beneath Western Harbour Walls Near Old Mill"
    rows = [
        ("a", "b", "Jon Harkar", p), ("b", "b", "Jon Harker", p), ("c", "b", "张无忌", p), ("d", "b", "张无记", p), ("e", "b", "张无双", p), ("f", "b", words, o), ("g", "b", words.replace("Lantern", "Lanterm"), o),
        ("h", "b", "桃铁丹商会", o), ("i", "b", "桃铁商会", o), ("j", "b", "桃铁丹商行", o), ("k", "b", "Jon Kellford", p), ("l", "b", "Jonathan Kellford", p), ("m", "b", "李明", p), ("n", "b", "黎鸣", p),
    ]
    assert groups(spark, rows) == {("a", "b"), ("c", "d"), ("f", "g"), ("h", "i"), ("k", "l")}


def test_keys_of_long_lists():
    codes = [f"k{i}" for i in range(500)]
    keys = nm.leave_one_out(codes)
    assert len(keys) == 501 and nm.leave_one_out(codes[::-1])[0] == keys[0]
    assert set(keys) & set(nm.leave_one_out(["other", *codes[1:]])) and not set(keys) & set(nm.leave_one_out(["x", "y", *codes[2:]]))


def test_linking_does_not_depend_on_the_size_of_the_table(spark):
    """The same pairs alone and among a thousand other names."""
    p = nm.PERSON
    rows = [("a", "b", "宁峰川", p), ("b", "b", "宁枫川", p), ("c", "b", "Umaric Tarnlow", p), ("d", "b", "Umarric Tarnlow", p)]
    rest = [(f"x{i}", f"o{i}", f"赵{chr(0x5000 + i)}{chr(0x6000 + i)}", p) for i in range(1000)]
    assert groups(spark, rows) == groups(spark, rows + rest) == {("a", "b"), ("c", "d")}
