"""One figure or organisation under several spellings.

Every different name of a book is parsed once:

- A full name gets block keys from the phonetic codes of its sorted tokens. Of a Latin token the code is made of its
  consonant classes; of an ideograph it is its reading without tone (ICU's transliteration, which comes with Spark), beside
  a class of characters that are taken for one another, from a fixed
  table and from what the corpus itself spells both ways within one record. Names
  that share a key are compared by Jaro-Winkler: Latin ones token by token, with an edit distance;
  ideographic ones character by character, characters of one class being equal.
- A short form (given name, initials, nickname, title with surname, acronym) names no one by itself. It claims
  the full names that could be meant, through the nickname table among others, and is linked
  if all of those in the book are one group.

Accepted pairs and the names of each record form a graph whose connected components are
the groups. Groups never cross books.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from storyloom.operators.graph import connected_components
from storyloom.session import written

PERSON, ORGANISATION, OTHER, UNKNOWN = "person", "organisation", "other", "unknown"
KINDS = {"CHR": PERSON, "ORG": ORGANISATION, "FAC": ORGANISATION, "SCT": ORGANISATION, "UNC": UNKNOWN, "UNMATCHED": UNKNOWN}
#: Least Jaro-Winkler similarity of two full names: Latin, ideographic ones that sound alike, organisations of which one lacks a character.
LEAST_SIMILAR, LEAST_SOUND, LEAST_SHORTER = 0.9, 0.69, 0.9
#: Two ideographs that don't sound alike count as alike if this share of the records that have the rarer one in a name spells it both ways.
ALIKE_SHARE = 0.1
#: A character that is not in the list counts as a surname if it begins this share of the names of three ideographs, and nine times as many as it stands elsewhere in.
FIRST_SHARE = 0.002

# Surnames, titles, nickname forms, characters of one sound or shape.
_COMPOUND = "司徒 端木 慕容 上官 欧阳 南宫 东方 独孤 诸葛 公孙 司马 夏侯 皇甫 尉迟 令狐 宇文 长孙 轩辕 闻人 百里 东郭 西门 公冶 钟离 澹台 拓跋".split()
_SURNAMES = set(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章苏潘葛范彭郎鲁韦马苗凤方俞任袁柳唐罗薛雷贺倪汤滕殷毕郝邬常乐于傅皮卞齐康伍余元卜顾孟黄穆萧尹姚邵汪祁毛狄贝明臧计伏成戴谈宋庞熊纪舒屈项祝董梁杜阮蓝闵席季贾路娄江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万柯卢莫房裘解应宗丁邓单洪包左石崔吉龚程裴陆翁荀甄曲封储靳段焦巴车侯全班宁仇甘厉戎祖武符刘景詹龙叶司黎薄白蒲邰赖卓蔺屠池乔双党翟谭劳申冉雍桑桂尚农温庄晏瞿阎充慕连习容向古易廖终衡耿匡寇广禄阙东欧沃利蔚越隆师巩聂晁简饶曾沙丰关相查荆红游竺权益岑楚闻商洛籍隗糜咸"
)
_TITLES_BEFORE = "神医 剑尊 捕头 少主 掌门 宗主 长老 圣女 魔尊 仙尊 道长 大侠 将军 少侠 公子".split()
_TITLES_AFTER = "师兄 师姐 师弟 师妹 前辈 将军 姑娘 先生 公子 大人 长老 掌门 道长 大侠 少侠 夫人 小姐 殿下 老师 女士 上校 队长 船长 爵士 伯爵".split()
_REGIONS = "江南 北境 旧朝 东海 西域 南疆 中原 关外 塞北 新朝".split()
_ORG_AFTER = "本部 总部 总舵 总坛".split()
_ORG_ENDS = "帮盟阁司宗门堂院军会派教庄殿楼府社团"
_ALIKE_GROUPS = (
    "尔耳 拉菈 利里莉 维薇 书殊舒 清轻青 姗珊 祉芷 昊皓浩 恒衡 文温雯纹 婉晚 玉誉钰煜昱 岚澜兰 凝宁 忒特 云匀芸 晨辰尘 儒如茹 峰锋枫 安桉 彦砚雁 苑远 樱英瑛 洛罗 惜熙曦 明鸣铭 瑶遥谣 萱轩 司思 子梓 周舟 凌翎泠 博柏伯 孟蒙 琦琪祺 林琳 夫芙 娜纳 亚娅"
).split()
_LATIN_TITLES = set("dr mr mrs ms miss sir dame lady lord ye the prof professor captain master mistress father mother brother sister old young".split())
_LATIN_SMALL = set("of the and ye for de du la le von van".split())
#: A nickname is in _NICKNAMES, or is the first three or four letters of a name and one of these.
_NICK_ENDS = ("ky", "sie", "kin", "ie", "y")
#: Given name: its nicknames.
_GIVEN = """
abigail abby gail; albert al bert bertie; alexander alex alec sandy xander; alexandra alex sandra sandy; alfred al alf fred alfie; andrew andy drew; ann annie nan nancy; anne annie nan nancy; anthony tony;
antonia toni; arthur art artie; barbara barb babs; benjamin ben benny; bernard bernie; bridget biddy bridie; catherine cathy cate kate kitty katie; charles charlie chuck chas; charlotte lottie charlie;
christina tina chris chrissie; christopher chris kit topher; cornelius neil con; daniel dan danny; david dave davy; deborah deb debbie; dorothea dot dolly; dorothy dot dottie dolly; edmund ed ned ted eddie;
edward ed ned ted eddie teddy; eleanor nell nellie ellie nora; elizabeth liz lizzie beth betty bess bessie eliza betsy libby lisa; emily em emmy millie; florence flo flossie; frances fanny fran frankie;
francis frank frankie; franklin frank; frederick fred freddie fritz; george geordie; geoffrey jeff geoff; gerald gerry jerry; gertrude gertie trudy; gilbert gil bert; gregory greg; harold hal harry; helen nell nellie;
henry harry hank hal; herbert bert herb; hugh hughie; isabella bella izzy; isabel bell izzy; jacob jake; james jim jimmy jamie; jane jenny janie; janet jenny jan; jennifer jenny jen; jeremiah jerry; jessica jess jessie;
john jack johnny; jonathan jon jonny; joseph joe joey; josephine jo josie; joshua josh; judith judy; katherine kate kathy katie kit kitty; kathleen kathy kate; lawrence larry; leonard len lenny; lewis lew; louis lou;
louisa lou; louise lou; margaret peggy meg maggie madge daisy greta rita peg; martha patty mattie; mary molly polly mamie; matilda tilly mattie; matthew matt; michael mike mick mickey; nathaniel nat nathan;
nicholas nick nicky; oliver ollie; patricia pat patty tricia; patrick pat paddy; penelope penny; peter pete; philip phil pip; rebecca becky; reginald reg reggie; richard dick rick rich ricky dickie; robert bob rob bobby robbie bert;
roger hodge; ronald ron ronnie; rosamund ros rose; samuel sam sammy; sarah sally sadie; solomon sol; stephen steve; steven steve; susan sue susie; susanna sue susie; terence terry; theodora dora; theodore ted teddy theo;
theresa tess terry; thomas tom tommy; timothy tim; victoria vicky tori; vincent vince; virginia ginny; walter walt wat; wilhelmina mina minnie billie; william bill will billy willie liam; winifred win winnie; zachary zach
"""
_NICKNAMES: dict[str, list[str]] = {}
for _words in map(str.split, _GIVEN.split(";")):
    for _word in _words[1:]:
        _NICKNAMES.setdefault(_word, []).append(_words[0])
_PLACE_WORDS = set("far lower upper north south east west old new grey saint high great little".split())
# End of the fixed values.

_DOTS = re.compile(r"[·・•‧.\-—–_/]")
_HAN = re.compile(r"[㐀-䶿一-鿿\U00020000-\U0003ffff]")
_QUOTED = re.compile(r"[\"“”„«»].*?[\"“”„«»]")


def _classes(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """character -> least character of its class, for classes joined by the pairs."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {c: top(c) for c in up}


FIXED_ALIKE = [(g[0], c) for g in _ALIKE_GROUPS for c in g[1:]]


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("æ", "ae")


def phonetic(token: str) -> str:
    """First letter and consonant classes of a Latin token; runs of one class count once, vowels not at all."""
    groups = {c: str(i) for i, g in enumerate(("aeiouyhw", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in g}
    out, last = token[:1], groups.get(token[:1])
    for c in token[1:]:
        code = groups.get(c, c)
        if code != last and code != "0":
            out += code
        last = code
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most `most` insertions, deletions, substitutions and adjacent swaps."""
    if abs(len(a) - len(b)) > most:
        return False
    two, before = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        two, before = before, row
    return before[-1] <= most


def same_latin(a: str, b: str) -> bool:
    """Whether two full Latin names (sorted tokens) are one up to a typing error."""
    x, y = a.split(), b.split()
    if re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return False
    if len(x) != len(y):
        return a.replace(" ", "") == b.replace(" ", "")
    if jaro_winkler(a, b) < LEAST_SIMILAR:
        return False
    left, right = [t for t in x if t not in y], [t for t in y if t not in x]
    # the tokens that differ, paired in sorted order; a first letter may be wrong, so for two of them both ways
    ways = [list(zip(left, right))] + ([list(zip(left, right[::-1]))] if len(left) == 2 else [])
    return any(len(w) <= 2 and all(min(len(p), len(q)) >= 3 and within_edits(p, q, 1) for p, q in w) for w in ways)


def same_ideographs(a: str, b: str) -> bool:
    """Whether two full ideographic names (class codes in order) are one: they sound alike and most characters are alike, or an organisation's name lacks one character of the other."""
    if len(a) == len(b):
        return jaro_winkler(a, b) >= LEAST_SOUND
    return abs(len(a) - len(b)) == 1 and min(len(a), len(b)) >= 4 and jaro_winkler(a, b) >= LEAST_SHORTER


def _mixed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def leave_one_out(codes: list[str]) -> list[str]:
    """The keys of a list of codes, in any order, and of the list without each of them: sums of their hashes, so their number and size grow with the list and no more."""
    hashes = [_mixed(c) for c in codes]
    total = sum(hashes) & (1 << 64) - 1
    return [f"{total:x}", *dict.fromkeys(f"{(total - h) & (1 << 64) - 1:x}|{len(codes)}" for h in hashes)]


class Parser:
    """Names to (full: comparable form or '', spelt: what is compared, keys, claims, offers). sounds: reading of an ideograph."""

    def __init__(self, alike: dict[str, str], surnames: set[str] = frozenset(_SURNAMES), ends: set[str] = frozenset(), sounds: dict[str, str] | None = None) -> None:
        self.alike, self.surnames, self.ends, self.sounds = alike, surnames, ends, sounds or {}

    def heard(self, text: str) -> str:
        """The key of names that sound like this one, in any order."""
        return "y:" + " ".join(sorted(self.sounds.get(c, c) for c in text))

    def code(self, text: str) -> str:
        return "".join(self.alike.get(c, c) for c in text)

    def parse(self, name: str, kind: str) -> dict:
        out = self.ideographs(name, kind) if _HAN.search(name) else self.latin(name, kind)
        return out | {"shaped": bool(out["full"]) and self.shaped(name, out)}

    def shaped(self, name: str, parsed: dict) -> bool:
        """Whether a full name looks like that of a person or an organisation, for records of unknown kind."""
        if re.search(r"\d", name):
            return False
        if not _HAN.search(name):
            tokens = folded(name).split()
            return "of" in tokens or (parsed["keys"][:1] != [] and parsed["keys"][0].startswith("p:") and len(parsed["full"].split()) == 2 and tokens[0] not in _PLACE_WORDS)
        if parsed["keys"][0].startswith("O:"):
            return True
        return name[-1] not in self.ends and ("·" in name or name[:2] in _COMPOUND or name[0] in self.surnames)

    def latin(self, name: str, kind: str) -> dict:
        bare = re.sub(r"\bo/t\b", "of the", folded(_QUOTED.sub(" ", name)))
        if (m := re.fullmatch(r"\s*([^,]+),\s*([^,]+?)\s*", bare)) and kind != ORGANISATION:
            bare = f"{m[2]} {m[1]}"
        short = {t.rstrip(".") for t in re.findall(r"[^\W\d_]{2,4}\.(?=\s|$)", bare)}
        letters = re.fullmatch(r"\s*((?:[^\W\d_]\.\s?){2,}|[^\W\d_]{2,5})\s*", name.casefold()) if kind != PERSON else None
        if letters and (("." in name) or name.isupper()):
            return _out("", [], ["ac:" + re.sub(r"\W", "", bare)], [])
        tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)?", bare)
        if tokens and tokens[0] in _LATIN_TITLES:
            tokens = tokens[1:]
        short = {t for t in short if t not in _LATIN_TITLES}
        if kind == ORGANISATION or "of" in tokens or (kind == UNKNOWN and bare.split()[:1] == ["the"]):
            tokens = [t for t in tokens if t not in _LATIN_SMALL]
            if len(tokens) < 2:
                return _out(tokens[0] if tokens else "", ["x:" + t for t in tokens], [], [])
            if len(tokens) == 2 and not re.search(r"\bof\b|,", bare):  # what stands before the name is left out
                return _out("", [], ["t:" + " ".join(tokens)], [])
            keys = ["o:" + k for k in leave_one_out(list(map(phonetic, tokens)))]
            return _out(" ".join(sorted(tokens)), keys, [], ["ac:" + "".join(t[0] for t in tokens), "t:" + " ".join(tokens[1:])])
        whole = [t for t in tokens if len(t) > 1 and t not in short]
        cut = [t for t in tokens if len(t) == 1 or t in short]
        nicknamed = lambda a, b: [f"N:{y}|{given}" for x, y in ((a, b), (b, a)) for given in _NICKNAMES.get(x, ())]
        nick = lambda t: next((t[: -len(e)] for e in _NICK_ENDS[:2] if t.endswith(e) and len(t) - len(e) == 3), t if len(t) <= 3 else "")
        if len(whole) == 2 and any(nick(t) not in ("", t) for t in whole):  # a stem of three letters and an ending
            return _out("", [], [f"i:{b}|{nick(a)}" for a, b in (whole, whole[::-1]) if nick(a)] + nicknamed(whole[0], whole[1]), [])
        if len(whole) >= 2:
            cut_short = [f"i:{b}|{a}" for a, b in (whole, whole[::-1]) if len(a) <= 3] if len(whole) == 2 else []  # may be short for a longer name, and a name of its own
            first, last = phonetic(whole[0]), phonetic(whole[-1])
            keys = ["p:" + " ".join(sorted((first, last)))]
            for a, b in ((whole[0], last), (whole[-1], first)):
                keys += [f"p:{b}|{a[0]}", f"p:{b}|-{a[-1]}"]
            offers = []
            for a, b in ((whole[0], whole[-1]), (whole[-1], whole[0])):
                offers += ["g:" + a, "n:" + a[:3], "n:" + a[:4], f"N:{b}|{a}", f"i:{a}|{b[0]}"] + [f"i:{b}|{a[:n]}" for n in (2, 3, 4)]
            return _out(" ".join(sorted(whole)), keys, nicknamed(whole[0], whole[-1]) + cut_short, offers)
        if len(whole) == 1 and cut:
            return _out("", [], [f"i:{whole[0]}|{cut[0]}"], [])
        if len(tokens) == 1:
            t = tokens[0]
            nick = next((t[: -len(e)] for e in _NICK_ENDS if t.endswith(e) and len(t) - len(e) >= 3), t)
            return _out("", [], ["g:" + t] + (["n:" + nick] if len(nick) in (3, 4) else []) + ["g:" + given for given in _NICKNAMES.get(t, ())], [])
        return _out("", [], [], [])

    def ideographs(self, name: str, kind: str) -> dict:
        joined = re.sub(r"\s+", "", _QUOTED.sub("", name))
        org = kind == ORGANISATION or (kind == UNKNOWN and re.search(f"[{_ORG_ENDS}][)）]?$", joined) and len(joined) > 3)
        if org:
            return self.organisation(joined)
        out = self.person(joined)
        if kind == UNKNOWN and not out["full"] and len(joined) in (2, 3):  # may be short for an organisation too
            out["claims"].append("a:" + self.code(joined))
        return out

    def organisation(self, text: str) -> dict:
        text = re.sub(r"[()（）\[\]【】《》的]", "", _DOTS.sub("", text))
        for r in _REGIONS:
            if text.startswith(r) and len(text) - len(r) >= 3:
                text = text[len(r) :]
        for r in _ORG_AFTER:
            if text.endswith(r) and len(text) - len(r) >= 2:
                text = text[: -len(r)]
        code = self.code(text)
        if len(text) < 4:  # the first part of a name, or it without what stands before its last character
            return _out("", [], ["a:" + code], [])
        shorter = ["q:" + code] + ["q:" + code[:i] + code[i + 1 :] for i in range(len(code))]
        return _out("".join(sorted(code)), ["O:" + "".join(sorted(code)), self.heard(text), *dict.fromkeys(shorter)], [], ["a:" + code[:2], "a:" + code[:2] + code[-1]], code)

    def person(self, text: str) -> dict:
        titled = False
        for t in _TITLES_BEFORE:
            if text.startswith(t) and len(text) > len(t):
                text = text[len(t) :]
        for t in _TITLES_AFTER:
            if text.endswith(t) and len(text) > len(t):
                text, titled = text[: -len(t)], True
        parts = [p for p in _DOTS.split(text) if p]
        if not parts:
            return _out("", [], [], [])
        if len(parts) == 2:
            a, b = parts
            if b in _COMPOUND or (b in self.surnames and len(a) <= 2 and "." not in text):
                return self.full(b + a)
            if len(b) == 1:
                return _out("", [], [f"d:{self.code(a)}|{self.code(b)}"], [])
            if len(a) == 1:
                return _out("", [], [f"d:{self.code(b)}|{self.code(a)}"], [])
            offers = ["P:" + self.code(p) for p in parts] + [f"d:{self.code(p)}|{self.code(q[0])}" for p, q in ((a, b), (b, a))] + ["l:" + self.code(a[0])]
            return self.whole("".join(parts), offers)
        text = "".join(parts)
        code = self.code
        surname = next((s for s in _COMPOUND if text.startswith(s)), text[0] if text[0] in self.surnames else "")
        given = text[len(surname) :]
        if titled and surname and not given:
            return _out("", [], ["s:" + surname], [])
        if len(text) == 2 and text[0] in "阿小老":
            return _out("", [], (["l:" + code(text[1])] if text[0] != "老" else []) + (["s:" + text[1]] if text[0] != "阿" else []), [])
        if len(text) == 2 and text[1] in "哥姐爷叔儿":
            return _out("", [], ["l:" + code(text[0])], [])
        if len(text) == 1:
            return _out("", [], ["l:" + code(text), "s:" + text], [])
        if not surname or text in _COMPOUND:
            return self.whole(text, []) if len(text) > 3 else _out("", [], ["G:" + code(text), "P:" + code(text)], [])
        return self.full(text)

    def full(self, text: str) -> dict:
        surname = next((s for s in _COMPOUND if text.startswith(s)), text[0])
        given = text[len(surname) :]
        if not given:
            return _out("", [], ["s:" + surname], [])
        offers = ["s:" + surname, "l:" + self.code(given[-1])]
        if len(given) > 1:
            offers += ["G:" + self.code(given), "G:" + self.code(given[::-1])]
        return self.whole(text, offers)

    def whole(self, text: str, offers: list[str]) -> dict:
        key = "".join(sorted(self.code(text)))
        return _out(key, ["h:" + key, self.heard(text)], [], offers, self.code(text))


def _out(full: str, keys: list[str], claims: list[str], offers: list[str], spelt: str = "") -> dict:
    return {"full": full, "spelt": spelt or full, "keys": keys, "claims": claims, "offers": offers}


def surnames_in_use(names: DataFrame) -> set[str]:
    """Known surnames that begin names of three ideographs at least a fifth as often as they stand elsewhere in them, and other characters that almost always begin them."""
    three = names.where(F.col("form").rlike(r"^[一-鿿]{3}$")).select("form").distinct()
    places = three.select(F.explode(F.array(*(F.struct(F.substring("form", i, 1).alias("c"), F.lit(int(i == 1)).alias("first")) for i in (1, 2, 3)))).alias("p"))
    counts = places.groupBy("p.c").agg(F.sum("p.first").alias("first"), F.sum(1 - F.col("p.first")).alias("later")).collect()  # one row for an ideograph of the basic block
    seen = {r["c"]: (r["first"], r["later"]) for r in counts}
    least = FIRST_SHARE * sum(a for a, _ in seen.values())
    return {c for c in _SURNAMES if 5 * seen.get(c, (1, 0))[0] >= seen.get(c, (1, 0))[1]} | {c for c, (a, b) in seen.items() if a >= least and a > 9 * b}


def readings(spark: SparkSession) -> dict[str, str]:
    """ideograph: its reading in Latin letters without tone, for those that have one (some 27,000, whatever the corpus)."""
    to_latin = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; NFD; [:Nonspacing Mark:] Remove; NFC")
    chars = [chr(i) for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000)) for i in range(a, b)]
    read = to_latin.transliterate(" ".join(chars)).split(" ")
    return {c: r for c, r in zip(chars, read) if r.isascii() and r} if len(read) == len(chars) else {}


def other_ends(names: DataFrame, kinds: DataFrame) -> set[str]:
    """Ideographs that end names of other kinds more often than names of persons."""
    ends = names.where(F.col("form").rlike(r"[一-鿿]$")).join(kinds.where(F.col("kind").isin(PERSON, OTHER)), "id").groupBy(F.right("form", F.lit(1)).alias("c")).agg(F.sum(F.when(F.col("kind") == OTHER, 1).otherwise(-1)).alias("n"))
    return {r["c"] for r in ends.where("n > 0").collect()}  # at most one row for an ideograph of the basic block


_LIST = ArrayType(StringType())
_PARSED = StructType([StructField("full", StringType()), StructField("spelt", StringType()), StructField("keys", _LIST), StructField("claims", _LIST), StructField("offers", _LIST), StructField("shaped", BooleanType())])


@pandas_udf(BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_ideographs(x, y) if _HAN.search(x) else same_latin(x, y) for x, y in zip(a, b)], dtype=bool)


def alike_characters(names: DataFrame, sounds: dict[str, str]) -> list[tuple[str, str]]:
    """Pairs of ideographs that records spell alternately in names that are otherwise equal: those that sound alike, and those of which ALIKE_SHARE of the records with the rarer one do.

    Names (id, form). Of each name the wildcards with one character left out are compared, so no two names are paired blindly. The pairs are read to the driver; there are as many as ideographs have readings in common.
    """
    short = names.where(F.length("form").between(2, 12) & F.col("form").rlike(r"^[一-鿿·]+$")).select("id", "form").distinct()
    at = F.explode(F.sequence(F.lit(1), F.length("form")))
    holes = short.select("id", "form", at.alias("at")).select("id", F.substring("form", F.col("at"), F.lit(1)).alias("c"), F.concat(F.expr("substring(form, 1, at - 1)"), F.lit("?"), F.expr("substring(form, at + 1)")).alias("hole"))
    seen = holes.where(F.col("c").rlike(r"[一-鿿]") & ~F.col("c").isin(*"阿小老"))
    uses = {r["c"]: r["n"] for r in seen.groupBy("c").agg(F.countDistinct("id").alias("n")).collect()}  # one row for an ideograph of the basic block
    spelt = seen.groupBy("id", "hole").agg(F.collect_set("c").alias("cs")).where(F.size("cs") > 1)
    pairs = spelt.select("id", F.explode("cs").alias("a"), "cs").select("id", "a", F.explode("cs").alias("b")).where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.countDistinct("id").alias("n")).collect()
    return [(r["a"], r["b"]) for r in counts if sounds.get(r["a"], "?") == sounds.get(r["b"], "!") or r["n"] >= ALIKE_SHARE * min(uses[r["a"]], uses[r["b"]])]


def _node(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def name_groups(names: DataFrame, kinds: DataFrame, within: str) -> DataFrame:
    """(id, within, group): records that stand for the same person or organisation have one group.

    names: (id, within, form), forms as from unified_names; kinds: (id, kind). Records of a kind OTHER, with a null id
    or null `within` take no part. A group without a record that is a person or an organisation by its kind or the shape of a full name is left out, as
    is a record linked to no other. Repeated rows count once; empty tables give no rows.
    """
    spark = names.sparkSession
    rows = names.where(F.col("id").isNotNull() & F.col(within).isNotNull()).select("id", F.col(within).alias("w"), "form").distinct().join(kinds.where(F.col("kind") != OTHER).distinct(), "id")
    rows, names, kinds = written(rows, "names"), names.select("id", "form").distinct(), kinds.distinct()
    sounds = readings(spark)
    parser = spark.sparkContext.broadcast(Parser(_classes(FIXED_ALIKE + alike_characters(rows, sounds)), surnames_in_use(rows.where(F.col("kind") == PERSON)), other_ends(names.where(F.col("id").isNotNull()), kinds), sounds))

    @pandas_udf(_PARSED)
    def parsed(form: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parser.value.parse(f, k) for f, k in zip(form, kind)], columns=["full", "spelt", "keys", "claims", "offers", "shaped"])

    rows = written(rows.withColumn("p", parsed("form", "kind")).select("id", "w", "form", "kind", "p.*"), "parsed")
    record, name = _node(F.lit("record"), "w", "id"), _node(F.lit("name"), "w", "full")
    full = rows.where("full <> ''")
    own = full.select(record.alias("a"), name.alias("b"))
    keyed = full.select("w", "full", "spelt", F.explode("keys").alias("key")).distinct()
    x, y = (keyed.select("w", "key", F.col("full").alias(f"full_{s}"), F.col("spelt").alias(f"spelt_{s}")) for s in "xy")
    shorter = ~F.col("key").startswith("q:") | (F.length("spelt_x") != F.length("spelt_y"))  # a key with a character left out joins a name with its shorter form only
    near = x.join(y, ["w", "key"]).where((F.col("full_x") < F.col("full_y")) & shorter).select("w", "full_x", "full_y", "spelt_x", "spelt_y").distinct().where(_same("spelt_x", "spelt_y"))
    near = near.select(_node(F.lit("name"), "w", "full_x").alias("a"), _node(F.lit("name"), "w", "full_y").alias("b"))
    stands = F.substring("key", 1, 2).isin("N:", "i:")
    meant = full.select("w", name.alias("b"), F.explode("offers").alias("key")).where(stands)
    said = full.select("w", name.alias("a"), F.explode("claims").alias("key")).where(stands).join(meant, ["w", "key"]).where("a <> b")  # a nickname or short given name beside a surname
    said = said.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b = most").select("a", "b")
    first = written(connected_components(own.union(near).union(said).distinct(), "a", "b"), "groups")

    offers = full.select("w", F.explode("offers").alias("key"), name.alias("node")).distinct().join(first, "node").groupBy("w", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    known = full.select("w", "id").distinct()
    partial = rows.where("full = ''").join(known, ["w", "id"], "left_anti")
    claims = partial.select("w", "id", "form", F.explode("claims").alias("key")).join(offers, ["w", "key"], "left")
    given = F.min(F.when(F.col("key").startswith("G:"), F.col("key")))  # a given name without a full one is known by its sound, other short forms by their spelling
    meant = claims.groupBy("w", "id", "form").agg(F.min("least").alias("least"), F.max("most").alias("most"), given.alias("given"))
    one = meant.where("least = most").select(record.alias("a"), F.col("least").alias("b"))
    none = meant.where("least IS NULL").select(record.alias("a"), _node(F.lit("short"), "w", F.coalesce("given", "form")).alias("b"))
    rest = partial.where(F.size("claims") == 0).select(record.alias("a"), _node(F.lit("short"), "w", "form").alias("b"))
    # short forms join groups; only they and the groups they join are gone through again
    joined = connected_components(one.union(none).union(rest).distinct(), "a", "b")
    groups = first.select("node", F.col("component").alias("_c")).join(joined.select(F.col("node").alias("_c"), F.col("component").alias("_j")), "_c", "left").select("node", F.coalesce("_j", "_c").alias("component"))
    groups = groups.unionByName(joined)
    seen = F.max(F.col("kind").isin(PERSON, ORGANISATION) | F.col("shaped")).alias("known")
    members = rows.groupBy("id", "w").agg(seen).withColumn("node", record).join(groups, "node")
    known = members.groupBy("component").agg(F.max("known").alias("known"), (F.min("id") != F.max("id")).alias("several")).where("known AND several")
    return members.join(known, "component", "left_semi").select("id", F.col("w").alias(within), F.hex("component").alias("group")).distinct()


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records of a group."""
    a, b = (groups.select("group", F.col("id").alias(f"id_{s}")) for s in "ab")
    return a.join(b, "group").where("id_a < id_b").select("id_a", "id_b").distinct()
