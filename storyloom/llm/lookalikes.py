"""Names that look the same brought to one form.

1. Of every name, whatever the script: forms of other width, composed and decomposed
   accents, compatibility ideographs and radicals are unified; characters without width
   are removed; every blank is a space; blanks at the ends are cut.
2. Script-aware repair: a token whose letters are of more than one script, or of another script than the
   rest of its name, gets the look-alikes of its dominant script put in, whichever script that is, but only when the
   result is in the corpus vocabulary: it occurs as a token that needs no repair, or at least two
   different spellings repair to it. A word that is rightly in another script stays.

Tokens in need of repair meet the vocabulary in a join, so neither is sent anywhere whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from storyloom.session import written

# Letters of the same shape, other form then the form it looks like.
_TO_LATIN = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԚԜҮԌѴӀаеѕіјорсухһԁԛԝүѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοινρυκχαϲϳσω" "օոսհցԼՏՕՍզյ" "ɑɡ" "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
        "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃᎡ" "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ" "ⲀⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬ",
        "ABESIJKMHOPCTYXQWYGVIaesijopcyxhdqwyvl" "ABEZHIKMNOPTYXCJoivpukxacjow" "onuhgLSOUqj" "ag" "IVXLCDMivxlcdm"
        "ABCDEGHJKLMPSTVWZR" "ABCDEFGHIJKLMNOPRSTUVWXYZ" "ABCEHIKMNOPTYX",
    )
)
_TO_HAN = dict(
    zip(
        "ロカニタエハトムノヨヒメオヌチㄚㄇㄈㄏㄩㄠㅡㅣㅁー㇐㇑〡〢〣" "⺀⺁⺄⺅⺇⺊⺌⺎⺘⺠⺩⺮⺼⻁⻄⻅⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰",
        "口力二夕工八卜厶丿彐匕乂才又千丫冂匚厂凵幺一丨口一一丨丨二三" "冫厂乙亻几卜小兀扌民王竹月虎西见贝车长门青页风飞食马骨鬼鱼鸟麦黄齐齿龙",
    )
)
# End of the fixed values.
_KEPT_TAGS = ("<wide>", "<narrow>", "<noBreak>")
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_WORD = re.compile(r"\w+")
LATIN, HAN = "LATIN", "CJK"
_BASE = _TO_LATIN | _TO_HAN


def _unit(c: str) -> str:
    if c.isspace() or c == "⠀":
        return " "
    kind = unicodedata.decomposition(c)
    if kind.startswith(_KEPT_TAGS) or ("⺀" <= c <= "⿟" and kind.startswith("<compat>")):
        return unicodedata.normalize("NFKC", c)
    return c


def form(name: str) -> str:
    """Step 1 of the module: the form of a name before any letter is replaced by one of another script."""
    if name.isascii():
        return re.sub(r"\s", " ", _INVISIBLE.sub("", name)).strip()
    return unicodedata.normalize("NFC", "".join(map(_unit, _INVISIBLE.sub("", name)))).strip()


def script(c: str) -> str | None:
    """The first word of the character's Unicode name, for letters; ideographs are one script."""
    if not c.isalpha():
        return None
    return HAN if unicodedata.name(c, "?").startswith("CJK") else unicodedata.name(c, "?").split(" ")[0]


@cache
def _table(main: str) -> dict[str, str]:
    """character of another script: the letter of script `main` that has its shape."""
    own = {base: c for c, base in reversed(_BASE.items()) if script(c) == main} | {base: base for base in _BASE.values() if script(base) == main}
    alike = {c: own[base] for c, base in _BASE.items() if base in own} | own
    return {c: to for c, to in alike.items() if script(c) != main}


def repairs(name: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(tokens as they are, [(token, what it looks like), ...], likelier ones first) of a name in form().

    The dominant script of a token is that of most of its letters, at a tie that of most letters of the name, then Latin or ideographs. A token with letters of several scripts, or wholly in one
    script in a name of which at least half is in others, may be meant in the dominant script (of the token, of the name), or with every letter in its basic form, as where most letters of a
    word were exchanged or a letter stands beside ideographs.
    """
    if name.isascii():
        return _WORD.findall(name), []
    whole = [s for c in name if (s := script(c))]
    plain, odd = [], []
    for token in _WORD.findall(name):
        own = [s for c in token if (s := script(c))]
        changed = []
        if len(set(own)) > 1 or (own and 2 * len(own) <= len(whole) and len(set(whole)) > 1):
            among = own if len(set(own)) > 1 else whole
            main = max(dict.fromkeys(among), key=lambda s: (own.count(s) if among is own else 0, whole.count(s), s in (LATIN, HAN)))
            changed = ["".join(_table(main).get(c, c) for c in token), "".join(_BASE.get(c, c) for c in token)]
        found = [c for c in dict.fromkeys(changed) if c != token]
        if found:
            odd += [(token, c) for c in found]
        else:
            plain.append(token)
    return plain, odd


_PAIR = StructType([StructField("token", StringType()), StructField("rank", IntegerType()), StructField("looks", StringType())])
_SEEN = StructType([StructField("form", StringType()), StructField("plain", ArrayType(StringType())), StructField("odd", ArrayType(_PAIR))])


@pandas_udf(_SEEN)
def _seen(names: pd.Series) -> pd.DataFrame:
    forms = [form(n) for n in names]
    found = [repairs(f) for f in forms]
    return pd.DataFrame({"form": forms, "plain": [p for p, _ in found], "odd": [[{"token": a, "rank": i, "looks": b} for i, (a, b) in enumerate(o)] for _, o in found]})


@pandas_udf(StringType())
def _repaired(forms: pd.Series, accepted: pd.Series) -> pd.Series:
    out = []
    for f, pairs in zip(forms, accepted):
        known = {p["token"]: p["looks"] for p in pairs}
        out.append(_WORD.sub(lambda m, known=known: known.get(m[0], m[0]), f))
    return pd.Series(out, dtype=object)


def all_names(rows: DataFrame, key: str, name: str, aliases: str, *keep: str) -> DataFrame:
    """(key, *keep, name): one row for each different name or alias of a record. Null and blank names are left out."""
    own = F.col(name).cast("string")
    many = F.concat(F.array(own), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    names = rows.select(F.col(key).alias("id"), *keep, F.explode(many).alias("name")).where(F.col("name").isNotNull())
    return names.distinct()


def unified_names(names: DataFrame) -> DataFrame:
    """names (id, ..., name) with the column `form`: equal for names that look the same.

    Names that are blank, or of characters without width only, are left out. Repeated
    rows give one row; a column already called form is replaced. An empty table gives none. Names of any length are taken whole.
    """
    names = names.drop("form", "_s", "_plain", "_odd")
    seen = names.where(F.col("name").isNotNull()).distinct().withColumn("_s", _seen("name")).where(F.length("_s.form") > 0)
    seen = written(seen.select(*names.columns, F.col("_s.form").alias("form"), F.col("_s.plain").alias("_plain"), F.col("_s.odd").alias("_odd")), "seen")
    odd = seen.select(F.explode("_odd").alias("o")).groupBy("o.token", "o.looks").agg(F.min("o.rank").alias("rank"))
    attested = seen.select(F.explode("_plain").alias("looks")).join(odd.select("looks").distinct(), "looks", "left_semi").distinct()
    twice = odd.groupBy("looks").agg(F.countDistinct("token").alias("n")).where("n > 1").select("looks")
    known = attested.select("looks", F.lit(0).alias("found")).union(twice.select("looks", F.lit(1))).groupBy("looks").agg(F.min("found").alias("found"))
    accepted = odd.join(known, "looks").groupBy("token").agg(F.min(F.struct("found", "rank", "looks")).alias("a")).select("token", F.col("a.rank").alias("rank"), F.col("a.looks").alias("looks"))
    whole = seen.where(F.size("_odd") == 0).select(*names.columns, "form")
    suspect = seen.where(F.size("_odd") > 0)
    forms = suspect.select("form", F.explode("_odd.token").alias("token")).distinct()
    fixed = forms.join(accepted, "token").groupBy("form").agg(F.collect_list(F.struct("token", "rank", "looks")).alias("pairs"))  # as many as the name has tokens
    mended = suspect.join(fixed, "form", "left").withColumn("form", F.when(F.col("pairs").isNull(), F.col("form")).otherwise(_repaired("form", F.coalesce("pairs", F.array().cast(ArrayType(_PAIR))))))
    return whole.unionByName(mended.select(*names.columns, "form"))


def lookalike_pairs(unified: DataFrame, within: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of one `within` of which some names look the same without being the same string.

    Null ids and null groups take no part.
    """
    rows = unified.where(F.col("id").isNotNull() & F.col(within).isNotNull()).select(within, "form", "id", "name").distinct()
    several = rows.groupBy(within, "form").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select(within, "form")
    rows = rows.join(several, [within, "form"], "left_semi")
    a, b = (rows.select(within, "form", F.col("id").alias(f"id_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, [within, "form"]).where("id_a < id_b AND name_a <> name_b").select("id_a", "id_b").distinct()
