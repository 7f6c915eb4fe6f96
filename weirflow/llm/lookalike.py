"""One form for text that looks the same: compatibility and composition, case, blanks, hyphens, invisible characters and look-alike letters.

Values are brought to their visible form (compatibility normalisation, composed; blanks and hyphens as the plain ones; default-ignorable characters
removed; letters of another script in a word written in one script replaced by those they look like), and for comparison they are case-folded too. Every distinct
value of a batch is treated once; values of plain ASCII never leave the JVM.

Defined cases: null stays null, the empty string stays empty; blanks at the ends and runs of blanks are reduced in the key only; a word that mixes scripts takes the script
that most of its letters can only belong to, and a word whose letters could all be of either script stays as it is unless the field is ASCII by nature (ids and labels). Very long values are treated whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like a letter of the Latin alphabet, by script; pairs of (letter, Latin letter).
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Һ": "H", "һ": "h", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y", "ѵ": "v", "Ѵ": "V",
    "Ӏ": "I", "ӏ": "l", "г": "r", "п": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ҝ": "k", "ѡ": "w", "ҽ": "e", "ғ": "f", "ԃ": "d", "ӧ": "ö", "ё": "ë", "ї": "ï", "ӓ": "ä", "ӱ": "ÿ",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i",
    "κ": "k", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "τ": "t", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ε": "e", "σ": "o", "μ": "u", "β": "b", "ϱ": "p", "ϝ": "f", "ς": "c",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ք": "p", "Տ": "S", "Օ": "O", "Ս": "U", "ա": "w", "յ": "j", "լ": "l", "ռ": "n", "ւ": "i", "Լ": "L", "Ց": "g", "կ": "k", "վ": "v", "ր": "r", "խ": "k", "տ": "m"}
CHEROKEE = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ᏸ": "B",
    "Ꮍ": "y", "Ꮒ": "h", "Ᏻ": "G", "Ꮁ": "G", "Ꮖ": "I", "Ꮞ": "4", "Ꭵ": "i", "Ꮟ": "b", "Ꮷ": "d", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮜ": "U", "Ꮎ": "O", "Ꭹ": "Y",
}
OTHER = {
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ꞌ": "'", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɩ": "i", "ⅼ": "l", "ǃ": "!", "ɢ": "G", "ʀ": "R", "ʏ": "Y", "ʙ": "B", "ɴ": "N", "ʜ": "H", "ʟ": "L",
    "ᴀ": "A", "ᴇ": "E", "ᴊ": "J", "ᴋ": "K", "ᴍ": "M", "ᴘ": "P", "ᴛ": "T", "ᴜ": "U", "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M",
    "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "ⵔ": "O", "ƽ": "s", "ʋ": "v", "ʂ": "s", "ӡ": "3", "ℓ": "l",
}
#: Signs that look like the plain hyphen or the ideographs that look like katakana (and the other way round).
HYPHENS = "‐‑‒–—―−﹘﹣－⁃˗⸺➖֊᐀᠆‧­"
KATAKANA = {"ニ": "二", "ハ": "八", "カ": "力", "ロ": "口", "エ": "工", "タ": "夕", "ト": "卜", "オ": "才", "ヘ": "へ", "リ": "り", "ベ": "べ", "ペ": "ぺ", "ー": "一", "ミ": "彡", "メ": "乄", "ノ": "丿", "チ": "千", "セ": "七", "イ": "亻", "ム": "厶", "ネ": "衤", "ヒ": "匕"}
_IDEOGRAPH = {v: k for k, v in KATAKANA.items() if v not in "千七"}
#: Radicals without a compatibility mapping that look like an ideograph.
RADICALS = {"⺅": "亻", "⺉": "刂", "⺝": "月", "⺟": "母", "⺠": "民", "⺩": "王", "⺫": "罒", "⺮": "竹", "⺷": "羊", "⺾": "艹", "⻁": "虎", "⻄": "西", "⻘": "青", "⻑": "長", "⻝": "食", "⻢": "马", "⻤": "鬼", "⻨": "麦", "⻩": "黄", "⻫": "斉", "⻭": "歯", "⻯": "竜"}

LATIN_OF = {k: v for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, OTHER) for k, v in table.items() if len(k) == 1}
_CYRILLIC_OF = {v: k for k, v in CYRILLIC.items() if len(k) == 1 and v.isascii() and k in "АВЕКМНОРСТУХаеорсухіЅѕ"} | {"ë": "ё"}

#: Default-ignorable characters (Unicode 15), as ranges.
IGNORABLE = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
_IGNORE = re.compile(f"[{IGNORABLE}]")
_BLANKS = re.compile(r"[   -   　\t\n\x0b\x0c\r  \x85]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_RUNS = re.compile(r"[^\W\d_]+|[^\W_]+")
_WORDS = re.compile("[\\w'’ー々〆\u0300-\u036f\u3099\u309a]+")


@lru_cache(1 << 14)
def _script(ch: str) -> str:
    c = ord(ch)
    if c < 0x80 or 0xC0 <= c <= 0x24F or 0x1E00 <= c <= 0x1EFF:
        return "latin"
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "greek"
    if 0x30A0 <= c <= 0x30FF:
        return "katakana"
    if 0x3040 <= c <= 0x309F:
        return "hiragana"
    if 0x3400 <= c <= 0x9FFF or c == 0x3005 or 0x20000 <= c <= 0x3FFFF:
        return "han"
    return "other"


def _word(word: str) -> str:
    """A word with look-alike letters of other scripts replaced by those of its own."""
    letters = [c for c in word if c.isalpha()]
    scripts = {_script(c) for c in letters}
    if scripts <= {"latin"} and not any(c in OTHER for c in letters):
        return word
    if scripts & {"latin", "cyrillic", "greek", "other"} and len(scripts) > 1 or scripts == {"other"} or any(c in OTHER for c in letters):
        bound = {"latin": 0, "cyrillic": 0, "greek": 0}
        for c in letters:
            s = _script(c)
            if s == "latin" and c not in _CYRILLIC_OF and c not in OTHER:
                bound["latin"] += 1
            elif s != "latin" and s in bound and c not in LATIN_OF:
                bound[s] += 1
        likely = max(bound, key=lambda s: (bound[s], s == "latin", sum(_script(c) == s for c in letters)))
        if bound["cyrillic"] == bound["latin"] == bound["greek"] == 0:
            likely = max(("latin", "cyrillic", "greek"), key=lambda s: sum(_script(c) == s for c in letters)) if scripts & {"latin", "cyrillic", "greek"} else "latin"
        if likely == "latin":
            return "".join(LATIN_OF.get(c, c) for c in word)
        if likely == "cyrillic":
            return "".join(_CYRILLIC_OF.get(LATIN_OF.get(c, c) if _script(c) != "cyrillic" else c, c) if _script(c) != "cyrillic" else c for c in word)
        return word
    if "katakana" in scripts and scripts & {"han", "hiragana"}:
        kata = sum(_script(c) == "katakana" for c in letters)
        return "".join(_IDEOGRAPH.get(c, c) for c in word) if kata * 2 >= len(letters) else "".join(KATAKANA.get(c, c) if c in KATAKANA and KATAKANA[c] in "二八力口工夕卜" else c for c in word)
    return word


def visible(value: str, ascii_field: bool = False) -> str:
    """The plainly written value that looks like value; letter case, spelling and plain blanks are kept."""
    if value.isascii() and not _BLANKS.search(value):
        return value
    v = _IGNORE.sub("", value)
    v = unicodedata.normalize("NFKC", _HYPHEN.sub("-", _BLANKS.sub(" ", v)))
    v = _IGNORE.sub("", _HYPHEN.sub("-", _BLANKS.sub(" ", v)))
    v = "".join(RADICALS.get(c, c) for c in v)
    if ascii_field:
        v = "".join(LATIN_OF.get(c, c) for c in v)
    else:
        v = _WORDS.sub(lambda m: _word(m.group()), v)
    return unicodedata.normalize("NFC", v)


def key(value: str, ascii_field: bool = False) -> str:
    """The form in which values compare: visible form, fully case-folded, blanks reduced."""
    return unicodedata.normalize("NFC", " ".join(visible(value, ascii_field).casefold().split()))


#: A value that can differ from its visible form, for the JVM: not ASCII only, or with other blanks than the plain one.
SUSPECT = r"[^\x20-\x7e]"


def _mapped(value: Column, f, ascii_field: bool) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        done = [f(v, ascii_field) for v in distinct] + [None]
        return pd.Series([done[c] for c in codes], dtype=object)

    return run(value)


def visible_form(value: Column, ascii_field: bool = False) -> Column:
    return F.when(value.rlike(SUSPECT), _mapped(F.when(value.rlike(SUSPECT), value), visible, ascii_field)).otherwise(value)


def compare_key(value: Column, ascii_field: bool = False) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(value), " +", " "))
    return F.when(value.rlike(SUSPECT), _mapped(F.when(value.rlike(SUSPECT), value), key, ascii_field)).otherwise(plain)


def disguised(df: DataFrame, row_key: str, value: Column, ascii_field: bool = False) -> DataFrame:
    """Rows whose value isn't written as it looks: row_key, value, plain."""
    x = df.select(row_key, value.alias("value")).filter(F.col("value").rlike(SUSPECT)).withColumn("plain", _mapped(F.col("value"), visible, ascii_field))
    return x.filter(F.col("plain") != F.col("value"))
