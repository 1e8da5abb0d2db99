"""Column functions on strings."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_ENDS = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _ENDS, "")


def key_form(c: Column) -> Column:
    """The form in which keys are compared: white space at the ends removed, lower case; blank becomes null."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


#: The same for DuckDB, as a format string.
KEY_FORM_SQL = r"nullif(lower(regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')), '')"


#: Without white space at both ends, for DuckDB; a format string.
STRIPPED_SQL = r"regexp_replace({0}, '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g')"


# First GBK code (as a negative number) of every initial letter of the first-level characters, and the end of the last.
GBK_INITIALS = (
    (-20319, "A"), (-20283, "B"), (-19775, "C"), (-19218, "D"), (-18710, "E"), (-18526, "F"), (-18239, "G"), (-17922, "H"), (-17417, "J"), (-16474, "K"), (-16212, "L"), (-15640, "M"),
    (-15165, "N"), (-14922, "O"), (-14914, "P"), (-14630, "Q"), (-14149, "R"), (-14090, "S"), (-13318, "T"), (-12838, "W"), (-12556, "X"), (-11847, "Y"), (-11055, "Z"),
)
GBK_END = -10247


def normal_name(name: str | None) -> str | None:
    """Compatibility form, no blanks at the ends, beside brackets or in rows, small ASCII letters; null stays null."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKC", name).strip()
    text = re.sub(r"(?<=[〈《（(\[【])\s+|\s+(?=[〉》）)\]】])", "", text)
    return re.sub(r"\s+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def normal_name_sql(name: str) -> str:
    """normal_name for DuckDB, of an expression in a query that joins the one row of the view {nfkc} as nf."""
    blank = r"[\s\x0b\x85\p{Z}]"
    text = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({name}, '(?s).'), lambda x: coalesce(nf.m[x], x)), ''))"
    text = f"regexp_replace({text}, '^{blank}+|{blank}+$', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '([〈《（(\[【]){blank}+', '\1', 'g'), '{blank}+([〉》）)\]】])', '\1', 'g')"
    return f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}+', ' ', 'g')"


@pandas_udf(StringType())
def normal_name_udf(names: pd.Series) -> pd.Series:
    return names.map(normal_name, na_action="ignore")


def initial(text: str | None) -> str:
    """The initial under which a name is sorted: its ASCII letter or digit, else by the GBK range of its first character, else '#'."""
    text = (text or "").strip()
    if not text or text[0].isascii():
        return text[:1].upper() if text[:1].isalnum() else "#"
    code = int.from_bytes(text[0].encode("gbk", "ignore"), "big") - 65536
    if not GBK_INITIALS[0][0] <= code <= GBK_END:
        return "#"
    return GBK_INITIALS[bisect_right([start for start, _ in GBK_INITIALS], code) - 1][1]


def initial_sql(name: str) -> str:
    """initial for DuckDB, of an expression in a query that joins the one row of the view {initials} as ini."""
    first = f"substr({STRIPPED_SQL.format(f"coalesce({name}, '')")}, 1, 1)"
    return f"(CASE WHEN {first} = '' THEN '#' WHEN regexp_matches({first}, '^[A-Za-z0-9]$') THEN upper({first}) WHEN regexp_matches({first}, '^[\\x00-\\x7f]$') THEN '#' ELSE coalesce(ini.m[{first}], '#') END)"


@pandas_udf(StringType())
def initial_udf(texts: pd.Series) -> pd.Series:
    places, unique = pd.factorize(texts.fillna(""))
    return pd.Series([initial(t) for t in unique], dtype=object).take(places).reset_index(drop=True)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text, '' of an empty or null one."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(text, 256))


def squashed(text: Column, most: int) -> Column:
    """White space rows as one blank, cut to `most` characters with '...': struct(text, full_length, truncated)."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    long = F.length(plain) > most
    return F.struct(F.when(long, F.concat(F.left(plain, F.lit(most)), F.lit("..."))).otherwise(plain).alias("text"), F.length(plain).alias("full_length"), long.alias("truncated"))


def safe_filename(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), 1, 100), F.lit("")), fallback)


def chapter_label(idx: Column) -> Column:
    return F.when(idx.isNull(), "?").otherwise(F.concat(F.lit("第 "), (idx + 1).cast("string"), F.lit(" 章")))


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of a cut text being dots; never fewer than none."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(most - 3, 0)), F.lit("..."[:most]))).otherwise(text)


# Words by which a question asks for the timeline or for hints, and what is said where a volume begins.
TIMELINE_WORDS, HINT_WORDS = r"第\s*\d+\s*章|什么时候|时间线|顺序|经过", "伏笔|悬念|线索|未解|铺垫"
VOLUME = "新一卷《{book_title}》开始了。故事延续自世界观「{work_title}」。"


def asks_for_timeline(text: Column) -> Column:
    return text.rlike(TIMELINE_WORDS)


def asks_for_hints(text: Column) -> Column:
    return text.rlike(HINT_WORDS)


def volume_prompt(book: Column, work: Column, own: Column | None = None) -> Column:
    """What is said where a volume begins; a prompt of its own, if not blank, takes its place."""
    said = F.replace(F.replace(F.lit(VOLUME), F.lit("{book_title}"), F.coalesce(book, F.lit(""))), F.lit("{work_title}"), F.coalesce(work, F.lit("")))
    return said if own is None else F.coalesce(F.nullif(own, F.lit("")), said)


def chapters_asked_for(text: Column) -> Column:
    """Chapter indexes (number - 1) named in a question."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"第\s*(\d+)\s*章"), 1), lambda n: n.cast("int") - 1)


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlighted(text: Column, word: str) -> Column:
    """The escaped text with every occurrence of the word, in any case, in <mark>."""
    if not word:
        return html_escaped(text)
    plain = re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", word.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    return F.regexp_replace(html_escaped(text), f"(?i)({plain})", "<mark>$1</mark>")


def ngram_features(text: Column) -> Column:
    """Single ideographs and words of a lower-cased text, then their runs of two and of three joined."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\u4e00-\\u9fff]|[a-z0-9_]+)"), 1)
    # through an array of one, so that the tokens are found once and not for every run
    return F.flatten(F.transform(F.array(tokens), _runs))


def _runs(tokens: Column) -> Column:
    grams = [tokens]
    for n in (2, 3):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(starts, _joined_run(tokens, n)))
    return F.concat(*grams)


def _joined_run(tokens: Column, n: int):
    return lambda at: F.array_join(F.slice(tokens, at, F.lit(n)), "")


def joined_values(values: Column) -> Column:
    """A loosely typed list as text: its non-empty items, by commas."""
    return F.array_join(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
