import random

import numpy as np
import pytest
from storyloom.llm import pii, train_pii

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.parametrize(
    ("text", "right"),
    [("11010519491231002X", True), ("110105 19491231 002x", True), ("110105194912310021", False), ("110105194913310021", False), ("964-05-8887", True), ("１１０１０５１９４９１２３１００２Ｘ", True), ("12345", False)],
)
def test_numbers(text, right):
    assert pii.valid_id(text) is right


def spans(text):
    net = pii._model(pii.MODEL)
    return [(k, text[a:b]) for a, b, k in pii.reconciled(text, pii.tagged_spans(net.tag_texts([text])[0]))]


def test_items():
    text = "尊敬的赖筠芃老师：\n读者普遍喜欢虞婉。手机 +86 143-1725-1273（九点以后）。邮箱是night.owl+beta(at)shuxin.example，有空回我。样书寄到云汀省望溪市松涛巷二百五十号8栋2单元301室。\n此致\n糜昕"
    assert spans(text) == [("NAME", "赖筠芃"), ("PHONE", "+86 143-1725-1273"), ("EMAIL", "night.owl+beta(at)shuxin.example"), ("ADDRESS", "云汀省望溪市松涛巷二百五十号8栋2单元301室"), ("NAME", "糜昕")]
    text = "Dear Merrit Cutterby,\nNext week I post 82 chapters. SSN 908-15-5501, My new number is 206.555.0191. I moved to Flat 17, 232 Saltmarsh St, Wexcombe last month. Batch 2024-489-367178. Order 992882196103015963 is not mine."
    assert spans(text) == [("NAME", "Merrit Cutterby"), ("ID_NUMBER", "908-15-5501"), ("PHONE", "206.555.0191"), ("ADDRESS", "Flat 17, 232 Saltmarsh St, Wexcombe")]


def test_windows_do_not_matter():
    """An item found in a short text is found at any place of a long one, over every seam."""
    net, item = pii._model(pii.MODEL), "Write to proof+beta@tingzhou.example any time. "
    filler = "The wind from Grimcrwatch smelled of cold tea. "
    for n in range(0, 30):
        text = filler[: n * 3] + filler * 9 + item + filler * 12
        got = [text[a:b] for a, b, k in pii.reconciled(text, pii.tagged_spans(net.tag_texts([text])[0])) if k == "EMAIL"]
        assert got == ["proof+beta@tingzhou.example"]


def test_held_out_accuracy():
    """Of texts the model was not trained on, against the labels of their fixed openings, forms and check characters."""
    import pandas as pd

    texts = pd.read_parquet(DOCS).text.dropna().tolist()
    silver = train_pii.Silver(pd.read_parquet("/root/testdata/sf0.1/documents.parquet").text.dropna().tolist())
    net = train_pii.scored({k: v for k, v in np.load(pii.MODEL).items()}, [(t, silver.spans(t)) for t in texts])
    for kind, (precision, recall, n) in net.items():
        assert n > 20 and precision >= 0.98 and recall >= 0.98, (kind, precision, recall, n)


def test_shortcut_is_exact():
    net, rng = pii._model(pii.MODEL), np.random.default_rng(1)
    scores = rng.normal(0, 3, (40, len(pii.TAGS), 30)).astype(np.float32)
    scores[:, 0] += 4
    free = net._viterbi(scores.copy())
    lead = (scores[:, 0] - scores[:, 1:].max(1)).min(0) > 2 * net.detour + 1e-3
    assert not free[:, lead].any()
    t, lane = 25, 3  # Viterbi against all paths of three steps
    small = scores[t : t + 3, :, lane]
    paths = [(small[0, a] + net.w["start"][a] + net.w["cross"][a, b] + small[1, b] + net.w["cross"][b, c] + small[2, c], (a, b, c)) for a in range(11) for b in range(11) for c in range(11)]
    assert tuple(net._viterbi(small[:, :, None].copy())[:, 0]) == max(paths)[1]


def test_gradients():
    rng, random_ = np.random.default_rng(2), random.Random(2)
    w = {k: v.astype(np.float64) for k, v in train_pii.initial(rng).items()}
    text = "Dear Ivo Tregarrow, call 212-555-0126 now."
    b, c = (x[:, None].astype(np.int64) for x in pii.encoded(text))
    tags = np.array([[random_.randrange(11)] for _ in text])
    loss = lambda: train_pii.gradients(w, b, c, tags, np.random.default_rng(9), drop=0.0)
    _, g = loss()
    for name in ("out", "cross", "start", "fw_h", "bw_c", "fw_b", "kinds"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step, held = 1e-3, w[name][at]
        w[name][at] = held + step
        up = loss()[0]
        w[name][at] = held - step
        down = loss()[0]
        w[name][at] = held
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=1e-2), name


def test_tables(spark):
    mail = "E-mail：shuangye@mail.weir.example；"
    rows = [(1, mail, "x"), (2, None, "x"), (3, "", "x"), (1, mail, "x"), (None, mail + "完", "x"), (4, "无事。" * 3, "x"), (5, "长" * 60_000 + mail, "x"), (6, "Readers like Nevtrin Kellford but find Umaric Tarnlow too false.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    found = pii.personal_spans(df, "doc_id", "text")
    got = {(r.doc_id, r.kind, r.start_pos, r.end_pos) for r in found.collect()}
    assert got == {(1, "EMAIL", 7, 33), (None, "EMAIL", 7, 33), (5, "EMAIL", 60_007, 60_033)}
    masked = {(r.doc_id, r.text) for r in pii.masked(df, found, "doc_id", "text").collect()}
    assert (1, "E-mail：<EMAIL>；") in masked and (None, "E-mail：<EMAIL>；完") in masked and (2, None) in masked and (3, "") in masked and (4, "无事。" * 3) in masked
    assert pii.masked(df, found, "doc_id", "text").count() == len(rows)
    assert pii.personal_spans(df.where("doc_id = 99"), "doc_id", "text").count() == 0


def test_figures_are_left_out(spark):
    spans = spark.createDataFrame([(1, "NAME", "Ivo Tregarrow"), (1, "NAME", "Kes Kellford"), (1, "EMAIL", "kes kellford")], "doc_id int, kind string, found string")
    figures = spark.createDataFrame([("KES KELLFORD",), (None,)], "name string")
    assert {(r.kind, r.found) for r in pii.without_figures(spans, figures).collect()} == {("NAME", "Ivo Tregarrow"), ("EMAIL", "kes kellford")}


def test_runtime_and_numpy_score_alike():
    """Windows of unequal lengths, more than one batch of the runtime's, characters outside the tables."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1@．张號 \n\U0001f600é") for _ in range(rng.randrange(0, 900))) for _ in range(90)]
    fast = pii._model(pii.MODEL)
    assert fast.session is not None
    plain = pii.Model(fast.w, runtime=False)
    assert all((a == b).all() for a, b in zip(fast.tag_texts(texts), plain.tag_texts(texts)))
    symbols = np.array(rng.choices(range(1, pii.BUCKETS * pii.CLASSES), k=50 * 7), np.int32).reshape(50, 7)
    assert np.abs(fast.scores(symbols, [50] * 7) - plain.scores(symbols, [50] * 7)).max() < 1e-3
