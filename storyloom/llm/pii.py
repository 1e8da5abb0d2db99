"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions.

The model (trained by train_pii.py in numpy, stored beside this module) reads a text in
overlapping windows. Each window is decoded by Viterbi; where windows overlap, every
character takes its tag from the window it lies deepest in. Spans are then reconciled over the whole
text: a span cut by a seam is joined, a name found once is marked wherever the
text repeats it, and spans that overlap are settled in favour of the longer.
Last, an exact check sets the ends of each span by the form of its kind, and drops
what can't be of the kind (a citizen number without valid date or check character, an
address without a house number). The check looks only where the model found something.
Names that are entities of the stories are removed by a join.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.names import _COMPOUND
from storyloom.llm.onnx_graph import tagger

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Characters of a window, those it shares with the next, windows decoded at once, and of these run by ONNX Runtime at once.
WINDOW, OVERLAP, LANES, SESSION_LANES = 384, 32, 512, 64
BUCKETS, POINTS = 4096, 0x20000
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")

# ---- characters


def _bucket(c: str) -> int:
    folded = unicodedata.normalize("NFKC", c).lower()[:1] or c
    return 1 + (ord(folded) * 2654435761 >> 7) % (BUCKETS - 1)


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    if kind == "Nd":
        return 1 if c.isascii() else 2
    if c in "零〇一二三四五六七八九":
        return 3
    if kind in ("Lu", "Lt"):
        return 4
    if kind == "Ll":
        return 5
    if kind[0] == "L":
        return 6
    if c in "@＠﹫":
        return 7
    if c in ".．。-－–+＋()（）[]":
        return 8
    if c in "\n\r":
        return 9
    if c.isspace():
        return 10
    return 11 if kind[0] == "P" else 12


CLASSES = 13


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) for i in range(POINTS)]
    return np.array([_bucket(c) for c in chars], np.int32), np.array([_class(c) for c in chars], np.int32)


def encoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, class) of every character."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), POINTS - 1)
    buckets, classes = _tables()
    return buckets[points], classes[points]


# ---- network


def _session(w: dict[str, np.ndarray]):
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
    return onnxruntime.InferenceSession(tagger(w), options, providers=["CPUExecutionProvider"])


class Model:
    """Forward pass and decoding. The pass is run by ONNX Runtime where it can be imported (fused gates, one call a batch of windows), else in numpy; the scores are the same to 1e-5.

    In numpy the products of the embeddings with the input weights are one table, so a step costs a lookup and one recurrent product.
    """

    def __init__(self, weights: dict[str, np.ndarray], runtime: bool = True) -> None:
        w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w, self.hidden = w, w["fw_h"].shape[0]
        n = self.hidden
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: with the first three gates halved here, a step takes one tanh
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), n)
        self.inputs, self.recurrent = {}, {}
        for d in ("fw", "bw"):
            table = (w["chars"] @ w[f"{d}_c"])[:, None] + (w["kinds"] @ w[f"{d}_k"] + w[f"{d}_b"])[None]
            self.inputs[d] = np.ascontiguousarray((table * half).reshape(BUCKETS * CLASSES, 4 * n))
            self.recurrent[d] = np.ascontiguousarray(w[f"{d}_h"] * half * np.float32(0.5))
        # A detour from O gains at most this by each transition it takes
        self.session = _session(w) if runtime else None
        self.detour = max(0.0, float(w["cross"].max() - w["cross"][0, 0]), float(w["start"].max() - w["start"][0]))

    def scores(self, symbols: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Scores [time, tag, lane] of windows in order of length; symbols [time, lane] are bucket * CLASSES + class, 0 for padding."""
        out = np.empty((symbols.shape[0], len(TAGS), symbols.shape[1]), np.float32)
        out[:] = self.w["out_b"][:, None]
        if self.session is not None:
            bucket, kind = np.divmod(symbols, np.int32(CLASSES))
            for i in range(0, len(lengths), SESSION_LANES):
                lanes = slice(i, min(i + SESSION_LANES, len(lengths)))
                length = np.array(lengths[lanes], np.int32)
                out[: length[-1], :, lanes] = self.session.run(None, {"bucket": bucket[: length[-1], lanes], "class": kind[: length[-1], lanes], "length": length})[0]
            return out
        # the symbols in use, numbered: their part of the tables stays near the processor
        number = np.zeros(BUCKETS * CLASSES, np.int32)
        number[symbols] = 1
        used = np.append(0, np.flatnonzero(number[1:]) + 1)
        number[used] = np.arange(len(used))
        for d, t in self.inputs.items():
            self._run(d, t[used], number[symbols], out)
        return out

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with np.load(path) as f:
            return cls({k: f[k] for k in f.files})

    def _run(self, direction: str, table: np.ndarray, symbols: np.ndarray, scores: np.ndarray) -> None:
        """Adds a direction's part to scores [time, tag, lane]; symbols [time, lane] are rows of table, 0 for padding."""
        steps, lanes = symbols.shape
        n, recurrent = self.hidden, self.recurrent[direction]
        out = np.ascontiguousarray((self.w["out"][:n] if direction == "fw" else self.w["out"][n:]).T * np.float32(0.5))
        h, c = np.zeros((lanes, n), np.float32), np.zeros((lanes, n), np.float32)
        z, r, t1, e = np.empty((lanes, 4 * n), np.float32), np.empty((lanes, 4 * n), np.float32), np.empty((lanes, n), np.float32), np.empty((len(TAGS), lanes), np.float32)
        live = (symbols > 0).astype(np.float32)[:, :, None]
        padded = ~live.all((1, 2))
        gates, i, f, o, u = z[:, : 3 * n], z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        for t in range(steps) if direction == "fw" else range(steps - 1, -1, -1):
            np.take(table, symbols[t], axis=0, out=z, mode="clip")
            np.dot(h, recurrent, out=r)
            z += r
            np.tanh(z, out=z)
            gates += 1  # twice the sigmoids
            np.multiply(i, u, out=t1)
            c *= f
            c += t1
            c *= 0.5
            if padded[t]:
                c *= live[t]  # padding holds no memory
            np.tanh(c, out=t1)
            np.multiply(t1, o, out=h)  # twice the state: its weights are halved
            np.dot(out, h.T, out=e)
            scores[t] += e

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence of each lane, [time, lane]."""
        # where O leads everywhere by more than any detour could gain, the best path is O throughout
        closest = (scores[:, 0] - scores[:, 1:].max(1)).min(0)
        open_ = np.flatnonzero(closest <= 2 * self.detour + 1e-3)
        out = np.zeros((scores.shape[0], scores.shape[2]), np.int8)
        if len(open_):
            out[:, open_] = self._viterbi(np.ascontiguousarray(scores[:, :, open_]))
        return out

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        """scores [time, tag, lane], overwritten. Which tag came before is found again on the way back, for the best path only."""
        steps, n, lanes = scores.shape
        cross, ways = self.w["cross"][:, :, None], np.empty((n, n, lanes), np.float32)
        scores[0] += self.w["start"][:, None]
        for t in range(1, steps):
            np.add(scores[t - 1][:, None], cross, out=ways)
            scores[t] += ways.max(0)
        out = np.empty((steps, lanes), np.int8)
        out[-1] = scores[-1].argmax(0)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = (scores[t - 1] + self.w["cross"][:, out[t]]).argmax(0)
        return out

    def tag_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, a tag for every character, from overlapping windows."""
        codes = [b * np.int32(CLASSES) + c for b, c in map(encoded, texts)]
        out = [np.zeros(len(t), np.int8) for t in texts]
        windows = []
        for i, t in enumerate(texts):
            at = 0
            while t:
                windows.append((min(WINDOW, len(t) - at), i, at))
                if at + WINDOW >= len(t):
                    break
                at += WINDOW - OVERLAP
        windows.sort()  # alike lengths together
        for k in range(0, len(windows), LANES):
            part = windows[k : k + LANES]
            width = part[-1][0]
            symbols = np.zeros((len(part), width), np.int32)
            for lane, (n, i, at) in enumerate(part):
                symbols[lane, :n] = codes[i][at : at + n]
            found = self.tags(self.scores(np.ascontiguousarray(symbols.T), [n for n, _, _ in part]))
            for lane, (n, i, at) in enumerate(part):
                first = at + (OVERLAP // 2 if at else 0)
                last = at + n if at + n == len(texts[i]) else at + n - OVERLAP // 2
                out[i][first:last] = found[first - at : last - at, lane]
        return out


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of one kind; a second B starts a new one."""
    kinds = (tags.astype(np.int64) + 1) // 2
    begins = (tags % 2 == 1) & (tags > 0)
    edges = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | begins)
    out = []
    for a, b in zip(edges, [*edges[1:], len(tags)]):
        if kinds[a]:
            out.append((int(a), int(b), KINDS[kinds[a] - 1]))
    return out


# ---- exact check: the forms of the kinds

_DIGIT = r"[\d零〇一二三四五六七八九]"
_GAP = r"[\s\-–－.·]"
_AT = r"(?:\s{0,2}[@＠﹫]\s{0,2}|\s{0,2}[\[(（{<【]\s?(?i:at)\s?[\])）}>】]\s{0,2}|\s(?i:at)\s|\s?艾特\s?)"
_DOT = r"(?:[.．]|\s?[\[(（{<【]\s?(?i:dot)\s?[\])）}>】]\s?|\s(?i:dot)\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}")
_PHONE = re.compile(rf"(?<!{_DIGIT})(?:[(（]?[+＋]\s?\d{{1,3}}[)）]?{_GAP}?|[(（]?00\d{{2}}[)）]?{_GAP}?)?(?:[(（]\d{{1,5}}[)）]{_GAP}?)?{_DIGIT}(?:{_GAP}?{_DIGIT}){{6,13}}(?!{_DIGIT})")
_NUMBER = re.compile(rf"(?<![\d])(?:\d{{6}}[\s\-–.]?\d{{8}}[\s\-–.]?\d{{3}}[\dXxＸｘ]|\d{{3}}[\s\-–.]\d{{2}}[\s\-–.]\d{{4}})(?![\d])")
_ZH_NUM = r"[0-9０-９零〇一二三四五六七八九十百]+"
_ZH_HOUSE = re.compile(rf"{_ZH_NUM}\s?号(?:\s?{_ZH_NUM}\s?(?:号楼|栋|幢|座|楼))?(?:\s?{_ZH_NUM}\s?单元)?(?:\s?{_ZH_NUM}\s?(?:层|楼))?(?:\s?{_ZH_NUM}\s?(?:室|户|房))?(?:\s?{_ZH_NUM}(?:-{_ZH_NUM})+)?")
_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Row|Close|Terrace|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Hill|Gardens|Grove|Mews|Boulevard|Blvd|Walk|Parade)"
_EN_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Room|Rm)\.?\s?#?\w{1,5}"
_EN_HOUSE = re.compile(rf"(?i:(?:{_EN_UNIT},?\s)?\d{{1,5}}[A-Za-z]?\s(?:[\w'’\-]+\s){{1,4}}?{_EN_STREET}\b(?:,\s{_EN_UNIT})?)(?:,\s[A-Z][\w'’\-]+(?:\s[A-Z][\w'’\-]+){{0,2}})?")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")
_LATIN_NAME = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STICKY = re.compile(r"^[\s.,;:!?，。；：！？、·\"“”‘’'()（）<>\[\]\-—]+|[\s.,;:!?，。；：！？、·\"“”‘’'()（）<>\[\]\-—]+$")
_FORMS = re.compile(r"(?:尊敬的|亲爱的|老师|编辑|主编|先生|女士|小姐|作者|读者|责编|收件人|抄送|您好|你好)+$|^(?:尊敬的|亲爱的|责编|收件人|抄送|编辑)+")
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def valid_id(text: str) -> bool:
    """A citizen number with a possible birth date and right check character, or three groups of a social security number."""
    s = "".join(str(unicodedata.digit(c)) if c.isdigit() else "X" for c in text if c.isdigit() or c in "XxＸｘ")
    if len(s) == 9 and "X" not in s:
        return True
    if len(s) != 18 or "X" in s[:17]:
        return False
    month, day = int(s[10:12]), int(s[12:14])
    if not (1800 <= int(s[6:10]) <= 2100 and 1 <= month <= 12 and 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)):
        return False
    return "10X98765432"[sum(int(a) * b for a, b in zip(s, _WEIGHTS)) % 11] == s[17]


def _touching(pattern: re.Pattern, text: str, a: int, b: int, reach: int) -> tuple[int, int] | None:
    """The match that shares most characters with text[a:b]."""
    low = max(0, a - reach)
    found = [(min(b, m.end()) - max(a, m.start()), m.start(), m.end()) for m in pattern.finditer(text, low, min(len(text), b + reach))]
    found = [f for f in found if f[0] > 0]
    return max(found)[1:] if found else None


def _email(text, a, b):
    return _touching(_EMAIL, text, a, b, 64)


def _phone(text, a, b):
    hit = _touching(_PHONE, text, a, b, 24)
    if not hit:
        return None
    digits = sum(c.isdigit() or c in "零〇一二三四五六七八九" for c in text[hit[0] : hit[1]])
    return hit if 7 <= digits <= 15 else None


def _id(text, a, b):
    hit = _touching(_NUMBER, text, a, b, 24)
    return hit if hit and valid_id(text[hit[0] : hit[1]]) else None


def _address(text, a, b):
    if re.search(r"[㐀-鿿]", text[a:b]):
        m = _touching(_ZH_HOUSE, text, a, b, 12)
        if not m or m[0] <= a or "号" not in text[a : m[1]]:
            return None
        while a < m[0] and text[a] in " \t：:，,、\n\r":
            a += 1
        return a, m[1]
    return _touching(_EN_HOUSE, text, a, b, 32)


def _name(text, a, b):
    piece = text[a:b]
    if re.search(r"[㐀-鿿]", piece):
        m = re.search(r"[㐀-鿿](?:[\s·]?[㐀-鿿])*", piece)[0]
        a += piece.index(m)
        while (f := _FORMS.sub("", m)) != m:
            a, m = a + m.index(f) if f else a, f
        surname = 2 if m[:2] in _COMPOUND else 1
        return (a, a + len(m)) if re.fullmatch(r"[㐀-鿿](?:[\s·]?[㐀-鿿]){1,3}", m) and len(m) > surname else None
    while a > 0 and (_LATIN.match(text[a - 1]) or (text[a - 1] in "'’-" and a > 1 and _LATIN.match(text[a - 2]))) and _LATIN.match(text[a]):
        a -= 1
    while b < len(text) and _LATIN.match(text[b - 1]) and (_LATIN.match(text[b]) or (text[b] in "'’-" and b + 1 < len(text) and _LATIN.match(text[b + 1]))):
        b += 1
    if letters := [i for i in range(a, b) if _LATIN.match(text[i])]:
        b = min(b, next((i for i in range(letters[0], b) if text[i].isalpha() and not _LATIN.match(text[i])), b))
    m = _STICKY.sub("", text[a:b])
    if not m:
        return None
    a += text[a:b].index(m)
    b = a + len(m)
    words = _LATIN_NAME.findall(m)
    if b < len(text) and text[b] == "." and len(words[-1] if words else "xx") == 1:
        b += 1  # the point of an initial
    if not 2 <= len(words) <= 4 or all(len(w) < 2 for w in words) or re.search(r"[\d\n\r@]", m):
        return None
    return a, b


_CHECKS = {"EMAIL": _email, "PHONE": _phone, "ID_NUMBER": _id, "ADDRESS": _address, "NAME": _name}


def reconciled(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Checked spans of a whole text that don't overlap, in order; names are marked wherever they are repeated."""
    joined: list[list] = []
    for a, b, kind in spans:
        if joined and joined[-1][2] == kind and a - joined[-1][1] <= 1 and kind != "NAME":
            joined[-1][1] = b
        else:
            joined.append([a, b, kind])
    found = {(*ends, kind) for a, b, kind in joined if (ends := _CHECKS[kind](text, a, b))}
    for name in {text[a:b] for a, b, kind in found if kind == "NAME"}:
        edge = r"(?<![^\W\d_])" if name[0].isascii() or unicodedata.name(name[0], "").startswith("LATIN") else ""
        after = r"(?![^\W\d_])" if edge and name[-1] != "." else ""
        found |= {(m.start(), m.end(), "NAME") for m in re.finditer(edge + re.escape(name) + after, text)}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda s: (s[0] - s[1], s)):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


@cache
def _model(path: str) -> Model:
    return Model.load(path)


#: Characters tagged at a time.
BATCH_CHARS = 1 << 20


def personal_spans(docs: DataFrame, key: str, text: str, model: str = MODEL) -> DataFrame:
    """(key, kind, start_pos, end_pos, found, text_hash): one row per occurrence in every row of docs.

    Positions count code points from 0, end exclusive. Null and empty texts have none; texts of any length
    are read whole; a repeated row is read again; other columns are dropped.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, kind string, start_pos bigint, end_pos bigint, found string, text_hash bigint"

    with np.load(model) as f:
        sent = docs.sparkSession.sparkContext.broadcast({k: f[k] for k in f.files})  # a quarter of a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (held == 0 or held + len(texts[end]) <= BATCH_CHARS):
                    held, end = held + len(texts[end]), end + 1
                rows = []
                for i, tags in zip(range(at, end), net.tag_texts(texts[at:end])):
                    if tags.any():
                        rows += [(i, k, a, b, texts[i][a:b]) for a, b, k in reconciled(texts[i], tagged_spans(tags))]
                if rows:
                    i, k, a, b, found = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(k), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.string()), batch.column(2).take(pa.array(i))], [key, "kind", "start_pos", "end_pos", "found", "text_hash"])
                at = end

    return docs.select(F.col(key), F.col(text), F.xxhash64(text)).mapInArrow(run, schema)


def without_figures(spans: DataFrame, names: DataFrame) -> DataFrame:
    """Without spans of kind NAME that are, letter for letter up to case, one of `names` (name)."""
    figures = names.select(F.lower("name").alias("_figure")).where("_figure IS NOT NULL").distinct()
    return spans.join(figures, (F.lower("found") == F.col("_figure")) & (F.col("kind") == "NAME"), "left_anti")


def masked(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every span replaced by its kind in angle brackets, all else as it was. One row per row of docs; null stays null.

    spans are those of personal_spans over the same docs; they belong to a row by key and text, so neither need be
    distinct or present. A text's spans are gathered in one row; they are as many as the text holds.
    """
    mark = F.struct("start_pos", "end_pos", "kind")
    marks = spans.groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set(mark)).alias("_marks"))
    own = docs.select(key, text)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, m: F.struct(F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, m["start_pos"] - acc["at"]), F.lit("<"), m["kind"], F.lit(">")).alias("done"), m["end_pos"].alias("at"))
    close = lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    joined = own.join(marks, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_hash")), "left")
    return joined.select(key, F.when(F.col("_marks").isNull(), F.col(text)).otherwise(F.aggregate("_marks", start, step, close)).alias(text))
