"""Trains the model of pii.py in numpy: python -m storyloom.llm.train_pii DOCUMENTS.parquet [OUT.npz].

No labels are given with the data, so they are made: the fixed openings and closings of letters and
notes give names and address units of which both ends are certain; their parts then label every
occurrence in the texts. Numbers are labelled by form and check character. Of the windows
drawn for training, most have their items exchanged for random ones (other name
characters, digits, streets), so that the model reads context and shape rather than known names.

At most MOST_DOCS documents are read (the first by a hash of doc_id) and STEPS * LANES windows drawn.
"""

from __future__ import annotations

import hashlib
import random
import re
import sys
import time
from collections import Counter

import numpy as np

from storyloom.llm.names import _COMPOUND, _SURNAMES
from storyloom.llm.pii import _EMAIL, _EN_HOUSE, _NUMBER, _ZH_HOUSE, BUCKETS, CLASSES, KINDS, MODEL, TAGS, Model, encoded, reconciled, tagged_spans, valid_id

MOST_DOCS, STEPS, LANES, LENGTH = 9000, 6000, 128, 80
CHARS, KIND_DIMS, HIDDEN = 24, 6, 16
HAN = r"[㐀-鿿]"
# Openings and closings that show both ends of a name (fixed values).
_ZH_NAMED = [rf"此致\s*\n({HAN}{{2,4}})\s*(?:\n|$)", rf"责编：({HAN}{{2,4}})。", rf"收件人({HAN}{{2,4}})。", rf"抄送({HAN}{{2,4}})，"]
_EN_NAMED = [r"Dear ([A-Z][\w'\-]+) ([A-Z][\w'\-]+),", r"Thanks to ([A-Z][\w'\-]+) ([A-Z][\w'\-]+) and all", r"Ask ([A-Z][\w'\-]+) ([A-Z][\w'\-]+) about it", r"regards,\s*\n\s*([A-Z][\w'\-]+) ([A-Z][\w'\-]+)\s*(?:\n|$)"]
_D = r"[\d零〇一二三四五六七八九]"
_PHONE = re.compile(
    rf"(?<![\d\-])(?:(?:[+＋]|00|００|〇〇|零零)?(?:86|８６|八六)[\s\-]?)?[1１一]{_D}{{2}}([\s\-]?){_D}{{4}}\1{_D}{{4}}(?![\d\-零〇一二三四五六七八九])"
    r"|(?<![\d\-])(?:\+44\s(?:\(0\)\s?)?7\d{3}\s\d{3}\s?\d{3}|07\d{3}\s\d{6}|(?:\+1[\s\-.])?\(?[2-9]\d\d\)?[\s\-.]?555[\s\-.]?\d{4})(?![\d\-])"
)


class Silver:
    """Labels from the parts found in the fixed openings and closings."""

    def __init__(self, texts: list[str]) -> None:
        surnames, given, first, last, units, streets = (Counter() for _ in range(6))
        for t in texts:
            for p in _ZH_NAMED:
                for name in re.findall(p, t):
                    cut = 2 if name[:2] in _COMPOUND else 1
                    surnames[name[:cut]] += 1
                    given.update(name[cut:])
            for p in _EN_NAMED:
                for a, b in re.findall(p, t):
                    first[a.capitalize()] += 1
                    last[b] += 1
            for m in re.finditer(rf"地址：({HAN}+?)(?=[0-9０-９一二三四五六七八九十百零]+号)", t):
                *before, street = re.findall(r".+?(?:省|市(?!路)|区|县)|.+$", m[1])
                units.update(before)
                streets[street] += 1
        often = lambda c, n: [k for k, v in c.items() if v >= n]
        self.surnames, self.given = often(surnames, 3), often(given, 5)
        self.first, self.last = often(first, 2), often(last, 2)
        self.units, self.streets = often(units, 3), often(streets, 2)
        any_of = lambda words: "(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True) or ["(?!)"]) + ")"
        self.zh_name = re.compile(f"{any_of(self.surnames)}{any_of(self.given)}{{1,2}}")
        f, l = any_of(self.first), any_of(self.last)
        self.en_name = re.compile(rf"(?<![^\W_])(?i:{f}(?:\s[A-Z]\.)?\s{l}|{l},\s{f}(?:\s[A-Z]\.)?|{f}\s[A-Z]\.|[A-Z]\.\s{l})(?![^\W_])")
        self.zh_address = re.compile(f"{any_of(self.units)}*{any_of(self.streets)}{_ZH_HOUSE.pattern}")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "EMAIL") for m in _EMAIL.finditer(text)]
        found += [(m.start(), m.end(), "ID_NUMBER") for m in _NUMBER.finditer(text) if valid_id(m[0]) and not re.search(r"(?:订单号|流水|批次|Order|Batch|ISBN)\s*$", text[: m.start()][-8:])]
        found += [(m.start(), m.end(), "PHONE") for m in _PHONE.finditer(text)]
        found += [(m.start(), m.end(), "ADDRESS") for p in (self.zh_address, _EN_HOUSE) for m in p.finditer(text)]
        found += [(m.start(), m.end(), "NAME") for p in (self.zh_name, self.en_name) for m in p.finditer(text)]
        kept: list = []
        for s in sorted(found, key=lambda s: s[0] - s[1]):
            if all(s[1] <= a or b <= s[0] for a, b, _ in kept):
                kept.append(s)
        return sorted(kept)


# ---- windows

_SYLLABLES = "ba be bi bo bra bre cal cor da de dor el en fa fen fi ga gla ha hal hes il iv ja jes jo ka kel la len lin lo lu ma mer mi mor na nel no ol or ott per pru qui ra ren ro sa sel si ta tel tho tor ul um va ver wil win ya zel zin".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((2, 2, 3)))).capitalize()


def exchanged(item: str, kind: str, rng: random.Random, silver: Silver) -> str:
    """A random item of the same shape."""
    if kind in ("PHONE", "ID_NUMBER"):
        return "".join(rng.choice("0123456789") if c in "23456789" and rng.random() < 0.7 else c for c in item)
    if kind == "EMAIL":
        return re.sub(r"[a-z]{4,}", lambda m: m[0] if m[0] in ("example", "test", "invalid") or rng.random() < 0.3 else _word(rng).lower(), item)
    if kind == "ADDRESS":
        if re.search(HAN, item):
            head = re.match(f"{HAN}*?(?=[0-9０-９一二三四五六七八九十百零]+号)", item)[0]
            new = re.sub(f"{HAN}{{2,3}}(?=[省市区县路街巷弄])", lambda m: m[0] if rng.random() < 0.4 else "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in m[0]), head)
            return new + item[len(head) :]
        return re.sub(r"[A-Z][a-z]{5,}", lambda m: m[0] if m[0] in ("Street", "Avenue", "Crescent") or rng.random() < 0.3 else _word(rng), item)
    if re.search(HAN, item):
        cut = 2 if item[:2] in _COMPOUND else 1
        surname = item[:cut] if rng.random() < 0.5 else rng.choice(list(_SURNAMES))
        return surname + "".join(c if rng.random() < 0.4 else chr(rng.randrange(0x4E00, 0x9FA0)) for c in item[cut:])
    like = str.upper if item.isupper() else str.lower if item.islower() else str
    return re.sub(r"[^\W\d_]{3,}", lambda m: m[0] if rng.random() < 0.5 else like(_word(rng)), item)


def window(text: str, spans: list, rng: random.Random, silver: Silver) -> tuple[str, np.ndarray]:
    """A stretch of the text, mostly around an item, with its tags."""
    way = rng.random()
    if way < 0.12:
        start = 0
    elif spans and way < 0.72:
        a, b, _ = rng.choice(spans)
        start = max(0, rng.randrange(b - LENGTH, a + 1) if b - LENGTH < a else a - 4)
    else:
        start = rng.randrange(max(1, len(text) - LENGTH // 2))
    swap = rng.random() < 0.6
    out, tags, at, end = [], [], start, start + LENGTH
    for a, b, kind in [s for s in spans if s[1] > start and s[0] < end]:
        if a > at:
            out.append(text[at:a])
            tags += [0] * (a - at)
        item = text[max(a, start) : b] if a < start else exchanged(text[a:b], kind, rng, silver) if swap else text[a:b]
        k = 1 + 2 * KINDS.index(kind)
        out.append(item)
        tags += [k + 1 if a < start else k] + [k + 1] * (len(item) - 1)
        at = max(at, b)
    if at < end:
        out.append(text[at:end])
    full = "".join(out)
    tags += [0] * (len(full) - len(tags))
    return full[:LENGTH], np.array(tags[:LENGTH], np.int64)


# ---- learning


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm_forward(x, w_h, mask):
    steps, lanes, _ = x.shape
    n = w_h.shape[0]
    h, c = np.zeros((lanes, n), np.float32), np.zeros((lanes, n), np.float32)
    kept = []
    for t in range(steps):
        z = x[t] + h @ w_h
        g = _sigmoid(z[:, : 3 * n])
        i, f, o, u = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(z[:, 3 * n :])
        before_c, before_h = c, h
        c = (f * c + i * u) * mask[t]
        th = np.tanh(c)
        h = o * th
        kept.append((i, f, o, u, before_c, before_h, th))
    return np.stack([k[2] * k[6] for k in kept]), kept


def lstm_backward(d_out, kept, w_h, mask):
    steps, lanes, n = d_out.shape
    dx, dw = np.empty((steps, lanes, 4 * n), np.float32), np.zeros_like(w_h)
    dh, dc = np.zeros((lanes, n), np.float32), np.zeros((lanes, n), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, u, c0, h0, th = kept[t]
        dh = dh + d_out[t]
        dc = (dc + dh * o * (1 - th * th)) * mask[t]
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], 1)
        dx[t] = dz
        dw += h0.T @ dz
        dh, dc = dz @ w_h.T, dc * f
    return dx, dw


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(scores, tags, mask, start, cross):
    """(mean loss, gradients of scores, start, cross) of full-length or padded lanes."""
    steps, lanes, n = scores.shape
    alpha = np.empty_like(scores)
    alpha[0] = scores[0] + start
    for t in range(1, steps):
        nxt = _lse(alpha[t - 1][:, :, None] + cross[None], 1) + scores[t]
        alpha[t] = np.where(mask[t], nxt, alpha[t - 1])
    total = _lse(alpha[-1], 1)
    beta, d_scores, d_cross = np.zeros((lanes, n), np.float32), np.zeros_like(scores), np.zeros_like(cross)
    lane = np.arange(lanes)
    gold = scores[0][lane, tags[0]] + start[tags[0]]
    for t in range(steps - 1, -1, -1):
        d_scores[t] = np.exp(alpha[t] + beta - total[:, None]) * mask[t]
        np.add.at(d_scores[t], (lane, tags[t]), -mask[t][:, 0])
        if t:
            on = mask[t][:, 0] > 0
            pair = np.exp(alpha[t - 1][:, :, None] + cross[None] + (scores[t] + beta)[:, None, :] - total[:, None, None])
            d_cross += pair[on].sum(0)
            np.add.at(d_cross, (tags[t - 1][on], tags[t][on]), -1)
            gold = gold + np.where(on, scores[t][lane, tags[t]] + cross[tags[t - 1], tags[t]], 0)
            beta = np.where(mask[t], _lse(cross[None] + (scores[t] + beta)[:, None, :], 2), beta)
    return float((total - gold).mean()), d_scores / lanes, d_scores[0].sum(0) / lanes, d_cross / lanes


def initial(rng) -> dict[str, np.ndarray]:
    n, tags = HIDDEN, len(TAGS)
    w = {"chars": rng.normal(0, 0.3, (BUCKETS, CHARS)), "kinds": rng.normal(0, 0.3, (CLASSES, KIND_DIMS)), "out": rng.normal(0, 0.2, (2 * n, tags)), "out_b": np.zeros(tags), "start": np.zeros(tags), "cross": rng.normal(0, 0.1, (tags, tags))}
    for d in ("fw", "bw"):
        w |= {f"{d}_c": rng.normal(0, CHARS**-0.5, (CHARS, 4 * n)), f"{d}_k": rng.normal(0, KIND_DIMS**-0.5, (KIND_DIMS, 4 * n)), f"{d}_b": np.repeat([0.0, 1.0, 0.0, 0.0], n), f"{d}_h": rng.normal(0, n**-0.5, (n, 4 * n))}
    w["chars"][0] = 0
    return {k: v.astype(np.float32) for k, v in w.items()}


def gradients(w, buckets, classes, tags, rng, drop=0.25):
    mask = (buckets > 0).astype(np.float32)[:, :, None]
    hidden = buckets.copy()
    hidden[(rng.random(buckets.shape) < 0.04) & (buckets > 0)] = 1 + rng.integers(0, BUCKETS - 1)  # unknown characters must be borne
    e, k = w["chars"][hidden], w["kinds"][classes]
    states, kept = [], {}
    for d in ("fw", "bw"):
        turn = (lambda x: x[::-1]) if d == "bw" else (lambda x: x)
        x = turn(e) @ w[f"{d}_c"] + turn(k) @ w[f"{d}_k"] + w[f"{d}_b"]
        h, kept[d] = lstm_forward(x, w[f"{d}_h"], turn(mask))
        states.append(turn(h))
    s = np.concatenate(states, 2)
    keep = (rng.random(s.shape) > drop).astype(np.float32) / (1 - drop)
    s = s * keep
    loss, d_scores, d_start, d_cross = crf(s @ w["out"] + w["out_b"], tags, mask, w["start"], w["cross"])
    g = {"start": d_start, "cross": d_cross, "out": np.tensordot(s, d_scores, ((0, 1), (0, 1))), "out_b": d_scores.sum((0, 1))}
    ds = (d_scores @ w["out"].T) * keep
    de, dk = np.zeros_like(e), np.zeros_like(k)
    for j, d in enumerate(("fw", "bw")):
        turn = (lambda x: x[::-1]) if d == "bw" else (lambda x: x)
        dx, g[f"{d}_h"] = lstm_backward(np.ascontiguousarray(turn(ds[:, :, j * HIDDEN : (j + 1) * HIDDEN])), kept[d], w[f"{d}_h"], turn(mask))
        g[f"{d}_c"] = np.tensordot(turn(e), dx, ((0, 1), (0, 1)))
        g[f"{d}_k"] = np.tensordot(turn(k), dx, ((0, 1), (0, 1)))
        g[f"{d}_b"] = dx.sum((0, 1))
        de += turn(dx @ w[f"{d}_c"].T)
        dk += turn(dx @ w[f"{d}_k"].T)
    g["chars"], g["kinds"] = np.zeros_like(w["chars"]), np.zeros_like(w["kinds"])
    np.add.at(g["chars"], hidden.ravel(), de.reshape(-1, CHARS))
    np.add.at(g["kinds"], classes.ravel(), dk.reshape(-1, KIND_DIMS))
    g["chars"][0] = 0
    return loss, g


def train(labelled: list[tuple[str, list]], silver: Silver, steps: int = STEPS, seed: int = 7, say=print) -> dict[str, np.ndarray]:
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    w = initial(rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    marked, plain = [x for x in labelled if x[1]], [x for x in labelled if not x[1] and x[0]]
    began = time.time()
    for step in range(1, steps + 1):
        buckets, classes = np.zeros((LENGTH, LANES), np.int64), np.zeros((LENGTH, LANES), np.int64)
        tags = np.zeros((LENGTH, LANES), np.int64)
        for lane in range(LANES):
            text, spans = pick.choice(marked if pick.random() < 0.7 or not plain else plain)
            piece, t = window(text, spans, pick, silver)
            b, c = encoded(piece)
            buckets[: len(b), lane], classes[: len(c), lane], tags[: len(t), lane] = b, c, t
        loss, g = gradients(w, buckets, classes, tags, rng)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.006 * min(1, step / 50) * (1 - step / (steps + 1)) ** 0.5 * min(1.0, 5 / (norm + 1e-6))
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        if step % 100 == 0 or step == 1:
            say(f"step {step}: loss {loss:.3f}, {time.time() - began:.0f} s")
    return w


def scored(w, labelled: list[tuple[str, list]]) -> dict[str, tuple[float, float, int]]:
    """Of each kind (precision, recall, items) against the made labels, after reconciling."""
    net, right, said, there = Model(w), Counter(), Counter(), Counter()
    texts = [t for t, _ in labelled]
    for (text, spans), tags in zip(labelled, net.tag_texts(texts)):
        got, want = set(reconciled(text, tagged_spans(tags))), set(spans)
        said.update(k for *_, k in got)
        there.update(k for *_, k in want)
        right.update(k for *_, k in got & want)
    return {k: (right[k] / max(1, said[k]), right[k] / max(1, there[k]), there[k]) for k in KINDS}


def main(args: list[str]) -> None:
    import pandas as pd

    docs = pd.read_parquet(args[0], columns=["doc_id", "text"]).dropna()
    docs["h"] = docs.doc_id.map(lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = docs.sort_values("h").text.head(MOST_DOCS).tolist()
    silver = Silver(texts)
    labelled = [(t, silver.spans(t)) for t in texts]
    held = labelled[: len(labelled) // 9]
    steps = int(args[2]) if len(args) > 2 else STEPS
    w = train(labelled[len(held) :], silver, steps, say=lambda s: print(s, flush=True))
    np.savez_compressed(args[1] if len(args) > 1 else MODEL, **{k: x.astype(np.float16) for k, x in w.items()})
    for k, (p, r, n) in scored({k: x.astype(np.float16) for k, x in w.items()}, held).items():
        print(f"{k}: precision {p:.4f}, recall {r:.4f} of {n}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
