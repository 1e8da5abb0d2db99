import base64
import random

import pytest
from storyloom.llm import packing, tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.vocabulary()


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(f"{tokens.TOKENIZERS_DIR}/{tokens.BYTE_BPE_50K}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocabulary, texts):
    flat, counts = vocabulary.encode(texts)
    ends = counts.cumsum()
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_ids_equal_the_public_library(vocabulary, public):
    rng = random.Random(4)
    texts = ["", "<|endoftext|>", "it's\r\n\r\n  two  ", "洛阳城外，" * 30, "a" * 3000, "字" * 1500, "é́​﻿𠮷😀", "\x00\x01", " " * 700, "ab" * 250 + "!" * 450]
    texts += ["".join(rng.choice(["the ", "雪", "7", "é", "\n", "x", ".", " "]) for _ in range(rng.randrange(300))) for _ in range(200)]
    assert ids(vocabulary, texts) == [public.encode_ordinary(t) for t in texts]
    assert ids(vocabulary, [None, ""]) == [[], []]


def test_long_words_agree_with_short_ones(vocabulary, monkeypatch):
    words = [w.encode() for w in ("abcabcabc" * 30, "之乎者也" * 40, "zzzz" * 60)]
    scanned = vocabulary.encode_words(words)
    monkeypatch.setattr(tokens, "LONG", 0)
    heaped = vocabulary.encode_words(words)
    assert scanned[0].tolist() == heaped[0].tolist() and scanned[1].tolist() == heaped[1].tolist()


def test_token_ids_of_documents(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "a b", None), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    rows = sorted(((r.doc_id or 0, r.ids) for r in tokens.token_ids(df, vocabulary).collect()))
    assert [k for k, _ in rows] == [0, 1, 1, 2, 3] and rows[3][1] == rows[4][1] == [] and rows[0][1] == rows[1][1] != []
    assert tokens.token_ids(df.where("doc_id > 9"), vocabulary).count() == 0
    assert {r.n_tokens for r in tokens.token_counts(df, vocabulary).collect()} == {0, 2}


def test_fullest_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(k) <= n for k, n in counts.items() if k in got)


def check(items, rows, capacity):
    used, cut = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.length
        cut.setdefault(r.id, []).append(r)
    assert all(u <= capacity for u in used.values()) and set(used) == set(range(len(used)))
    want = {k: n for k, n in items if n}
    assert set(cut) == set(want)
    for k, parts in cut.items():
        parts.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in parts] == list(range(len(parts))) and len(parts) == -(-want[k] // capacity)
        at = 0
        for r in parts:
            assert r.start == at
            at += r.length
        assert at == want[k] and [r.container for r in parts] == sorted(r.container for r in parts)
    return len(used)


def test_packing(spark):
    rng = random.Random(8)
    items = [(i, rng.choice([0, 1, 5, 60, 60, 60, 99, rng.randrange(1, 100), rng.randrange(1, 350)])) for i in range(900)] + [(5000, None)]
    df = spark.createDataFrame([(k, n, "x", 1, 2) for k, n in items], "id int, n bigint, length string, slice int, container int")
    bins = check([(k, n) for k, n in items if n], packing.packed(df, "id", "n", 100).collect(), 100)
    plain: list[int] = []  # first fit by falling size
    for n in sorted((r.length for r in packing.packed(df, "id", "n", 100).collect()), reverse=True):
        at = next((i for i, free in enumerate(plain) if free >= n), None)
        if at is None:
            plain.append(100 - n)
        else:
            plain[at] -= n
    assert bins <= len(plain)
    assert packing.packed(df.where("id < 0"), "id", "n", 100).count() == 0


def test_one_length_holds_most(spark):
    items = [(i, 7) for i in range(3000)] + [(9000 + i, 1) for i in range(20)]
    rows = packing.packed(spark.createDataFrame(items, "id int, n int"), "id", "n", 15).collect()
    assert check(items, rows, 15) == 1500
