"""Freely typed values mapped to the closest entry of a reference list.

The terms of the list (labels, translations, hints) make a symmetric-delete dictionary:
every string left of a term after deleting up to its number of permitted edits points to the
term. The value and the parts of it that may be the term are looked up by their own deletions, none at all included, so
no term is compared that isn't near and the list is never walked. Those found are ranked by weighted Damerau-Levenshtein distance; equal
terms by length, then by how late they stand (what comes before a term qualifies it); then by how
often the term is used as it stands in the corpus, then by their order in the list.
A dictionary of a checked size goes to the executors; a larger one is partitioned by deletion and joined.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from storyloom.llm.lookalikes import form, repairs

UNMATCHED = "UNMATCHED"
#: Most deletion entries of a dictionary that is sent to the executors (about 100 bytes each).
MOST_ENTRIES = 2_000_000
#: A term may differ by this share of its length, and by two edits at most (one below TWO_EDITS characters).
SHARE, TWO_EDITS = 0.35, 8
#: Cost of putting one character for another of the same sound, shape or meaning.
ALIKE = 0.3
#: Answers kept in a worker.
CACHE = 100_000

# Traditional and simplified forms of the characters of common type names.
_TRADITIONAL = dict(
    zip(
        "勢門組織軍團聯陣營會幫劍點場靈寶設戰儀術詞類規則獸種級脈氣鬥個國書龍東體關將師權職業語騎為義傳說號",
        "势门组织军团联阵营会帮剑点场灵宝设战仪术词类规则兽种级脉气斗个国书龙东体关将师权职业语骑为义传说号",
    )
)
# Characters taken for one another by sound or shape, in groups.
_GROUPS = (
    "物勿务 人入仁 势执執 力立历 组祖阻 织识职 宗棕综踪 门们问 地他她池 点占店 品晶 灵零玲 宝保 功攻工 法発发 境镜竟 界介届 种冲钟 族旅簇 兽受 概慨 念捻 规归 则责测 事亊是 件建健 "
    "未末味 分份 角脚 主住 反返 派哌 阵阴 联连 盟萌 朝潮 会绘 帮邦 军君 团困 剑箭 场厂 城诚 市是 名明 道到 具俱 器气 神伸 式试 等寺 级极 群裙 坐座 设没 战站 仪义 知只 其期 他它"
).split()
_CLOSE = {(a, b) for g in _GROUPS for a in g for b in g if a != b}
_PARTS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[㐀-鿿]")


def plain(value: str) -> str:
    """Compatibility form, small letters, simplified characters, without look-alikes, accents kept."""
    shown = form(value)
    table = dict(reversed(repairs(shown)[1]))  # the likeliest of several
    shown = re.sub(r"\w+", lambda m: table.get(m[0], m[0]), shown)
    return "".join(_TRADITIONAL.get(c, c) for c in unicodedata.normalize("NFKC", shown).casefold())


def edits(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1


def deletions(text: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(text) if i not in gone) for n in range(min(most, len(text)) + 1) for gone in combinations(range(len(text)), n)}


def distance(a: str, b: str) -> float:
    """Damerau-Levenshtein (adjacent swaps), a swap or a doubled letter a little cheaper, alike characters ALIKE."""
    before, row = [], [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [float(i)]
        for j, y in enumerate(b, 1):
            double = 0.9 if i > 1 and a[i - 2] == x else 1.0
            best = min(before[j] + double, row[j - 1] + 1.0, before[j - 1] + (0.0 if x == y else ALIKE if (x, y) in _CLOSE else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 0.9)
            row.append(best)
    return row[-1]


def candidates(value: str, longest: int, words: int) -> list[tuple[int, str]]:
    """(place, text) of the value in plain form, of its parts, of runs of up to `words` of them, and of stretches of parts written without blanks (up to `longest` characters)."""
    shown = plain(value)
    parts = _PARTS.findall(shown)
    if not parts:
        return []
    last = len(shown) + 1
    found = [(last, shown.strip()), (last, "".join(parts))]
    at = 0
    places = [(at := shown.index(p, at)) + len(p) for p in parts]
    for i, p in enumerate(parts):
        found += [(places[j], " ".join(parts[i : j + 1])) for j in range(i, min(i + words, len(parts)))]
        if _CJK.search(p):  # what was added may touch the term
            start = places[i] - len(p)
            found += [(start + a + n, p[a : a + n]) for n in range(2, min(longest, len(p) - 1) + 1) for a in range(len(p) - n + 1)]
    return list(dict.fromkeys(f for f in found if len(f[1]) <= longest + 2))


def lookups(text: str) -> set[str]:
    return deletions(text, 2 if len(text) >= TWO_EDITS - 2 else 1)


def rank(cost: float, place: int, term: str, uses: int, order: int) -> tuple:
    """What the best match has least of."""
    return (cost, -len(term) if cost == 0 else 0, -place if cost == 0 else 0, -uses, order)


def permitted(text: str, term: str) -> float | None:
    """The distance, if the term may differ so much."""
    cost = distance(text, term)
    return cost if cost <= min(SHARE * len(term), edits(term)) else None


@dataclass
class Terms:
    """Reference terms with their codes; uses: how often each is used as it stands."""

    codes: dict[str, str]
    uses: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.order = {t: i for i, t in enumerate(self.codes)}
        self.longest, self.words = max(map(len, self.codes), default=0), max((t.count(" ") + 1 for t in self.codes), default=1)
        self.near: dict[str, list[str]] | None = {}
        for term in self.codes:
            for d in deletions(term, edits(term)):
                self.near.setdefault(d, []).append(term)
            if len(self.near) > MOST_ENTRIES:
                self.near = None  # too many for every executor: joined instead
                break

    def closest(self, text: str) -> tuple[float, str] | None:
        """(cost, term) of the best term within its permitted distance of the whole text."""
        best = self._best([(0, text)])
        return best and (best[0][0], best[1])

    def code(self, value: str) -> str:
        best = self._best(candidates(value, self.longest, self.words))
        return self.codes[best[1]] if best else UNMATCHED

    def _best(self, texts: list[tuple[int, str]]) -> tuple[tuple, str] | None:
        ranked = [(rank(c, place, t, self.uses.get(t, 0), self.order[t]), t) for place, text in texts if len(text) <= self.longest + 2 for t in {t for d in lookups(text) for t in self.near.get(d, ())} if (c := permitted(text, t)) is not None]
        return min(ranked, default=None)


def terms_of(reference: DataFrame, code: str, columns: tuple[str, ...], word_lists: tuple[str, ...]) -> dict[str, str]:
    """{term in plain form: code}; the first of several entries for one term stays. The list is read to the driver."""
    out: dict[str, str] = {}
    rows = reference.select(code, *columns, *word_lists).orderBy(code).collect()
    for c in columns:
        for r in rows:
            if r[c] and plain(r[c]).strip():
                out.setdefault(plain(r[c]).strip(), r[code])
    for c in word_lists:
        for r in rows:
            for word in plain(r[c] or "").split():
                out.setdefault(word, r[code])
    return out


def mapped_values(rows: DataFrame, key: str, value: str, codes: dict[str, str], labels: list[str]) -> DataFrame:
    """(key, value, type_code): the distinct rows whose value is not null, blank or exactly one of labels.

    type_code is UNMATCHED where no term is meant. Long values are searched whole.
    An empty list leaves every value unmatched; other columns are dropped, a null key is kept.
    """
    spark = rows.sparkSession
    typed = rows.select(F.col(key), F.col(value).cast("string").alias(value)).where(F.col(value).isNotNull())
    used = typed.where(F.lower(value).isin(*codes)).groupBy(F.lower(value).alias("t")).agg(F.count("*").alias("n")).collect() if codes else []
    terms = Terms(codes, {r["t"]: r["n"] for r in used})
    typed = (typed.where(~F.col(value).isin(*labels)) if labels else typed).distinct()
    if terms.near is None:
        return _joined(typed, value, terms)
    known = _cached(spark.sparkContext.broadcast(terms))

    @pandas_udf(StringType())
    def code(values: pd.Series) -> pd.Series:
        places, unique = pd.factorize(values)
        return pd.Series([known(v) if v.strip() else None for v in unique], dtype=object).take(places).reset_index(drop=True)

    return typed.withColumn("type_code", code(value)).where(F.col("type_code").isNotNull())


def _joined(typed: DataFrame, value: str, terms: Terms) -> DataFrame:
    """mapped_values() by a join on deletions, for a dictionary of any size: the same matches and ranks."""
    spark, longest, words = typed.sparkSession, terms.longest, terms.words
    place_text = ArrayType(StructType([StructField("place", IntegerType()), StructField("text", StringType())]))
    listed = spark.createDataFrame([(t, c, terms.uses.get(t, 0), terms.order[t]) for t, c in terms.codes.items()], "term string, code string, uses bigint, ord int")

    @pandas_udf(place_text)
    def parts(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"place": p, "text": t} for p, t in candidates(v, longest, words)])

    @pandas_udf(ArrayType(StringType()))
    def of_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(lookups(t)))

    @pandas_udf(ArrayType(StringType()))
    def of_term(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(deletions(t, edits(t))))

    @pandas_udf(DoubleType())
    def cost(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([permitted(a, b) for a, b in zip(texts, found)], dtype="float64")

    values = typed.select(value).distinct().where(F.col(value).rlike(r"(?U)\S"))
    asked = values.select(value, F.explode(parts(value)).alias("p")).select(value, "p.place", "p.text")
    near = asked.select("text").distinct().select("text", F.explode(of_text("text")).alias("d")).join(listed.select("term", F.explode(of_term("term")).alias("d")), "d").select("text", "term").distinct()
    near = near.withColumn("cost", cost("text", "term")).where("cost IS NOT NULL AND NOT isnan(cost)").join(listed, "term")
    exact = lambda c: F.when(F.col("cost") == 0, -c).otherwise(0)
    best = asked.join(near, "text").groupBy(value).agg(F.min(F.struct("cost", exact(F.length("term")).alias("a"), exact(F.col("place")).alias("b"), (-F.col("uses")).alias("u"), "ord", "code")).alias("m"))
    codes = values.join(best, value, "left").select(value, F.coalesce("m.code", F.lit(UNMATCHED)).alias("type_code"))
    return typed.join(codes, value).select(*typed.columns, "type_code")


class _cached:
    """Terms.code with what was answered kept in the worker."""

    def __init__(self, sent) -> None:
        self.sent, self.found = sent, None

    def __getstate__(self):
        return self.sent

    def __setstate__(self, sent):
        self.__init__(sent)

    def __call__(self, value: str) -> str:
        if self.found is None:
            self.found = lru_cache(CACHE)(self.sent.value.code)
        return self.found(value)
