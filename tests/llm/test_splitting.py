import random

import pytest
from storyloom.llm import splitting as sp


def checked(text, limit=100, overlap=10):
    pieces = sp.cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    strong = sp.strengths(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= limit and d - c <= limit and c == b - overlap
        window = range(a + overlap + 1, a + limit + 1)
        assert strong[b] == max(strong[i] for i in window) and b == max(i for i in window if strong[i] == strong[b])
    return pieces


def test_against_plain_search():
    rng = random.Random(1)
    bits = ["word ", "字", "。", "！”", "\n\n", "\r\n", "a", ". Next ", "，", "　　", "é"]
    for _ in range(150):
        checked("".join(rng.choice(bits) * rng.randrange(1, 4) for _ in range(rng.randrange(1, 200))) or "x", rng.randrange(40, 120), rng.randrange(0, 30))


def test_kinds_of_boundary():
    assert [sp.strengths(t)[i] for t, i in (("a\n\nb", 3), ("a\nb", 2), ("a. B", 3), ("甲。乙", 2), ("甲，乙", 2), ("a b", 2), ("甲乙", 1), ("ab", 1), ("é", 1), ("\r\n", 1))] == [6, 5, 4, 4, 3, 2, 2, 1, 0, 5 * 0 + sp.strengths("\r\n")[1]]
    assert sp.strengths("\r\nx")[1] == sp.NEVER


def test_no_breaks_and_edges():
    assert checked("f" * 250) == [(0, 100), (90, 190), (180, 250)]
    assert sp.cuts("") == [] and sp.cuts("x" * 1500) == [(0, 1500)] and len(sp.cuts("x" * 1501)) == 2
    with pytest.raises(ValueError):
        sp.cuts("x", 10, 10)


def test_table(spark):
    long = "段落。\n\n" * 100_000
    rows = [("a", "x" * 1600, 1), ("b", None, 1), ("c", "", 1), ("d", "short", 1), (None, "y" * 1501, 1), ("a", "x" * 1600, 1), ("e", long, 1)]
    df = spark.createDataFrame(rows, "chapter_id string, content string, piece int")
    pieces = sp.split_pieces(df, "chapter_id", "content").collect()
    own = sorted((r for r in pieces if r.chapter_id == "e"), key=lambda r: r.piece_no)
    assert own[0].piece + "".join(r.piece[150:] for r in own[1:]) == long
    assert sum(r.chapter_id == "a" for r in pieces) == 4 and sum(r.chapter_id == "d" for r in pieces) == 1
    assert {r.chapter_id for r in sp.oversized(sp.split_pieces(df, "chapter_id", "content"), "chapter_id").collect()} == {"a", None, "e"}
    assert sp.split_pieces(df.where("piece = 2"), "chapter_id", "content").count() == 0


def test_least_advance():
    """A boundary early in the window is taken with an advance of 1; a greater one lets no piece bring less."""
    text = "a" * 153 + "\n\n" + "b" * 4000
    assert sp.cuts(text)[:2] == [(0, 155), (5, 1505)]
    pieces = sp.cuts(text, advance=500)
    assert all(b - a <= 1500 for a, b in pieces) and pieces[0][1] >= 650 and all(b - a >= 650 for a, b in pieces[:-1]) and len(pieces) <= len(text) / 500 + 1
    with pytest.raises(ValueError):
        sp.cuts(text, 100, 50, 51)
