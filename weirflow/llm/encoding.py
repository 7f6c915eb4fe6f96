"""Text that was read in the wrong character encoding: detection and restoration.

The garbled form of every repertoire character is computed beforehand for all pairs (true encoding, wrong encoding) and put into one
multi-pattern automaton. Matches name the pairs that a text may suffer from; under each of them the tokens of the text, and within a token
the spans of adjacent matches, are read back, and a reading is taken only where it has fewer anomalies (controls, replacement characters, symbols within words, mixed scripts, case changes
within words and so on) than the text as it stands. Only those tokens and spans are replaced, correct text beside them stays.

Defined cases: null stays null and is never found; empty and ASCII texts are returned as they are; a text with lost bytes (U+FFFD) is found
but only its restorable tokens are restored; long texts are processed whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (true encoding, encoding it was read in).
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "mac_roman"),
    ("utf-8", "koi8_r"),
    ("utf-8", "cp932"),
    ("utf-8", "cp1254"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp932"),
    ("mac_roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
    ("cp932", "cp1252"),
    ("cp932", "latin-1"),
    ("cp932", "mac_roman"),
    ("cp932", "cp437"),
    ("euc_jp", "cp1252"),
    ("euc_jp", "latin-1"),
    ("euc_jp", "cp932"),
    ("cp1251", "koi8_r"),
    ("cp1251", "latin-1"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"),
    ("koi8_r", "latin-1"),
    ("cp866", "cp1251"),
)

_WESTERN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿŠšŽžŒœ¿¡ºª½¼¾±«»°·–—‘’“”…€§"
_RUSSIAN = "".join(chr(c) for c in range(0x410, 0x450)) + "Ёё№"
_KANA = "".join(chr(c) for c in range(0x3041, 0x30FF)) + "、。「」・ー（），．：；！？　〜＋－０１２３４５６７８９"
_LATIN = ("", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UNSEEN = "\ufeff\u200b\xa0☎✓←→×÷○●◎△☆★※"
_HALF = "".join(chr(c) for c in range(0xFF61, 0xFFA0))


def _level1(ch: str) -> bool:
    """Whether ch is among the common kanji (first level of JIS X 0208)."""
    try:
        b = ch.encode("cp932")
    except UnicodeEncodeError:
        return False
    return len(b) == 2 and 0x88 <= b[0] <= 0x98


@cache
def _kanji() -> str:
    return "".join(c for c in map(chr, range(0x4E00, 0xA000)) if _level1(c))


#: cp932 bytes that have no character of their own, as decoders write them.
_ODD = {"cp932": {"\x80": 0x80, "": 0xA0, "": 0xFD, "": 0xFE, "": 0xFF}}


@cache
def _table(encoding: str) -> dict[str, bytes]:
    """Bytes of each character, undefined bytes standing for themselves as decoders without an error do."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, bytes([b]))
    if encoding == "cp932":
        for lead in [*range(0x81, 0xA0), *range(0xE0, 0xFD)]:
            for trail in range(0x40, 0xFD):
                try:
                    ch = bytes([lead, trail]).decode(encoding)
                except UnicodeDecodeError:
                    if lead < 0xF0 or trail == 0x7F:
                        continue
                    ch = chr(0xE000 + (lead - 0xF0) * 188 + trail - 0x40 - (trail > 0x7F))
                if len(ch) == 1:
                    out.setdefault(ch, bytes([lead, trail]))
        out |= {k: bytes([v]) for k, v in _ODD["cp932"].items()}
    return out


def _garble(data: bytes, wrong: str) -> str:
    """data as a lenient reader of the wrong encoding shows it."""
    if wrong != "cp932":
        back = _back(wrong)
        return "".join(back[b] for b in data)
    return data.decode("cp932", "replace")


@cache
def _back(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _repertoire(true: str) -> str:
    return {"cp1252": _WESTERN, "mac_roman": _WESTERN, "cp850": _WESTERN, "cp437": _WESTERN, "cp1251": _RUSSIAN, "koi8_r": _RUSSIAN, "cp866": _RUSSIAN, "cp932": _KANA + _kanji(), "euc_jp": _KANA + _kanji()}.get(true, _WESTERN + _RUSSIAN + _KANA + _HALF + _UNSEEN + _kanji())


@cache
def garbled_sequences() -> dict[str, tuple[int, ...]]:
    """Every garbled sequence with the numbers of the pairs that make it."""
    out: dict[str, set[int]] = {}
    for k, (true, wrong) in enumerate(PAIRS):
        for ch in _repertoire(true):
            try:
                data = ch.encode(true)
            except UnicodeEncodeError:
                continue
            swallowed = (*_LATIN, *(x for x in _WESTERN if x.islower())) if wrong == "cp932" and len(data) == 1 else ("",)  # a lead byte takes the letter after it along
            for lead, after in product((0, 1) if wrong == "cp932" and len(data) > 1 else (0,), swallowed):
                g = _garble(data[lead:] + after.encode(true), wrong)
                if wrong == "cp932":
                    g = g.replace("�", "").strip("\x00")
                    if not g or g.isascii():
                        continue
                if g != ch and not g.isascii():
                    out.setdefault(g, set()).add(k)
    return {g: tuple(sorted(k)) for g, k in out.items()}


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, k in garbled_sequences().items():
        a.add_word(g, (len(g), k))
    a.make_automaton()
    return a


_TOKEN = re.compile(r"[^\x00-\x3f]+")
_HARD = re.compile("\x1b\\$|[�\u0080-\u009f-\U000e0000-\U0010ffff]")
_L = r"A-Za-zÀ-ÖØ-öø-ɏ"
_SYMBOL = "¤¥¦§¨©®¯°²³´µ¶·¸¹¼¾¢£¬­ ÷×ƒ‚„†‡ˆ‰‹›•™˜˙˚˝˛ˇ˘…–—‘’“”«»€√∫Ω≈∂∏∑∆◊ﬁﬂ≤≥≠∞πªº±¿¡½ı─-╿▀-▟⌠⌡∙∩≡⁄"
_CHECKS = [
    (re.compile("[─-╿▀-▟⌠⌡√∫≈∂∏∑∆◊ﬁﬂ≡∙∩¤¦˙˚˝˛ˇ˘]"), 1.0),
    (re.compile("[‡†‰ˆΩ≤≥⁄Ωϖπ]"), 1.0),
    (re.compile(rf"(?<=[{_L}])[{_SYMBOL}](?=[a-zà-ÿ{_SYMBOL}])(?<!’)(?<!·)"), 1.0),
    (re.compile(rf"(?<![0-9])[…¬„‹›«»€‚ƒ¼¾²³¶§¨©®¯°´µ¸¹¢£¥](?=[{_L}])"), 0.8),
    (re.compile(r"[a-zß-öø-ÿ](?:[À-ÖØ-Þ]|(?<=[ß-öø-ÿ])[A-Z])"), 1.0),
    (re.compile(r"[а-яё](?=[А-ЯЁ])"), 1.0),
    (re.compile("[Ѐ-Џѐђ-џҐ-ӿ]"), 1.0),
    (re.compile(rf"[{_L}](?=[Ͱ-ϿЀ-ӿ])|[Ͱ-ϿЀ-ӿ](?=[{_L}])"), 1.0),
    (re.compile(rf"[а-яёА-ЯЁ](?=[{_SYMBOL}])|[{_SYMBOL}](?=[а-яёА-ЯЁ])"), 1.0),
    (re.compile(rf"[{_L}](?=[ｦ-ﾟ｡-･])|[ｦ-ﾟ｡-･](?=[{_L}])"), 1.0),
    (re.compile("[｡-･]"), 0.7),
    (re.compile(r"[a-zà-ÿ][一-鿿㐀-䶿](?=[a-zà-ÿ])"), 2.0),
    (re.compile("(?<![ｦ-ﾟ])[ｦ-ﾟ](?![ｦ-ﾟ])"), 0.8),
    (re.compile("[ª-ÿŒœŠšŽžŸƒ‚-›€™]{3,}"), 1.0),
    (re.compile("[ÃÂĂĹ├┬√ГВРС][ -¿­€-ↄ‚-›ѓ-џЂ-ЏА-яŒœŠšŽžŸ─-▟]"), 0.8),
    (re.compile("[ĂĹ](?=[łąşĽľżšśťžźŠŚŤŽŹŁĄŞŻ])"), 1.2),
    (re.compile("[縺繧繝郢ﾃﾂﾐﾑ][\u0080-￿]"), 0.6),
]


_HALF_WIDTH = re.compile("[ｦ-ﾟ]+")
#: Symbols that a garbled word may hold without being an anomaly by themselves.
_LOOSE = re.compile(f"[{_SYMBOL}]")


@cache
def _rare(ch: str) -> bool:
    return "一" <= ch <= "鿿" and not _level1(ch) or "㐀" <= ch <= "䶿"


@lru_cache(1 << 16)
def anomalies(token: str) -> float:
    """How much a token looks garbled; 0 for an ordinary word of any script."""
    if token.isascii():
        return 0.0
    score = 3.0 * len(_HARD.findall(token))
    for pattern, weight in _CHECKS:
        score += weight * len(pattern.findall(token))
    letters = [c for c in token if c.isalpha()]
    odd = sum("À" <= c <= "ɏ" for c in letters)
    if odd >= 3 and odd > 0.6 * len(letters):
        score += odd * 0.7
    score += 0.5 * sum(map(_rare, token))
    return score


@cache
def _allowed(ch: str) -> bool:
    c = ord(ch)
    if c < 0x80:
        return c >= 0x20
    if ch in _WESTERN or ch in _RUSSIAN or 0x3000 <= c <= 0x30FF or 0xFF01 <= c <= 0xFF9F or 0x4E00 <= c <= 0x9FFF or 0xC0 <= c <= 0x17F:
        return True
    return ch in "\ufeff☎†✓←→↑↓△▲○●◎◇◆□■★☆※〒℃№≒×÷´¨­"


def _encode(token: str, wrong: str) -> bytes | None:
    table = _table(wrong)
    out = bytearray()
    for ch in token:
        b = table.get(ch)
        if b is None:
            return None
        out += b
    return bytes(out)


@lru_cache(1 << 15)
def read_back(token: str, true: str, wrong: str) -> str | None:
    """token as it was before it was read in the wrong encoding (repeatedly, where only that gives proper characters), or None."""
    text, best = token, None
    while True:  # every further reading as UTF-8 is shorter
        data = _encode(text, wrong)
        if data is None or data.isascii():
            break
        try:
            text = data.decode(true)
        except UnicodeDecodeError:
            break
        if text != token and all(map(_allowed, text)) and (best is None or anomalies(text) < anomalies(best)):
            best = text
        if true != "utf-8":
            break
    return best


def _special(token: str, text: str, true: str, wrong: str) -> float:
    """Evidence that anomalies can't show: half-width letters that read back as a Latin letter or as common kanji."""
    if wrong != "cp932" or not all("ｦ" <= c <= "ﾟ" for c in token):
        return 0.0
    if true == "utf-8" and token[0] in "ﾂﾃ" and all(c in _WESTERN for c in text):
        return 1.0
    if true == "euc_jp" and len(token) >= 4 and len(token) % 2 == 0 and not re.search("[ﾞﾟｰ]", token) and all(_level1(c) for c in text):
        return 1.0
    return 0.0


def _matched(token: str) -> dict[int, list[tuple[int, int]]]:
    """Spans of adjacent garbled sequences in a token, for each pair that makes them."""
    out: dict[int, list[tuple[int, int]]] = {}
    for b, a, pairs in sorted((end + 1, end + 1 - n, pairs) for end, (n, pairs) in automaton().iter(token)):
        for k in pairs:
            found = out.setdefault(k, [])
            while found and found[-1][1] >= a:
                a = min(a, found.pop()[0])
            found.append((a, b))
    return out


#: Characters on each side of a span by which its reading is judged: as far as the checks look.
_BESIDE = 3


def _read_spans(token: str, spans: list[tuple[int, int]], true: str, wrong: str) -> str | None:
    """token with those of its spans read back that have fewer anomalies then; the rest stays. None if there are none.

    For UTF-8 read in one-byte encodings only: there a garbled sequence shows where its character begins, elsewhere matches also lie across characters or within correct text."""
    out, last = [], 0
    for a, b in spans:
        x = read_back(token[a:b], true, wrong)
        if x is None:
            continue
        left, right = token[max(0, a - _BESIDE) : a], token[b : b + _BESIDE]
        if anomalies(left + x + right) < anomalies(left + token[a:b] + right):
            out += [token[last:a], x]
            last = b
    return "".join([*out, token[last:]]) if out else None


#: A reading as UTF-8 that succeeds is rarely an accident, unlike one in which every byte means something.
_TRUST = {"utf-8": 2.0}


@lru_cache(1 << 16)
def _readings(token: str) -> tuple[float, tuple[tuple[int, float, str], ...]]:
    """Anomalies of a token, and its readings that are no worse: (pair, gain, text). Words recur, so most tokens are judged once per worker."""
    before = anomalies(token)
    loose = _LOOSE.search(token) is not None
    out = []
    if before or loose or _HALF_WIDTH.fullmatch(token):
        for k, spans in sorted(_matched(token).items()):
            true, wrong = PAIRS[k]
            if before == 0 and wrong != "cp932" and not loose:
                continue
            x, parts = read_back(token, true, wrong), _read_spans(token, spans, true, wrong) if true == "utf-8" and wrong != "cp932" else None
            gain = before + _special(token, x, true, wrong) - anomalies(x) if x is not None else 0.0
            if parts is not None and (x is None or before - anomalies(parts) > gain):
                x, gain = parts, before - anomalies(parts)
            if x is not None and (gain > 0 or gain == 0 and loose and not _LOOSE.search(x)):
                out.append((k, gain, x))
    return before, tuple(out)


Replaced = list[tuple[int, int, str]]


def _once(text: str) -> tuple[Replaced, int | None]:
    """What one pair explains: the spans to be replaced (start, end, text), in order, and the pair's number; none if no pair gains enough."""
    tokens = [(m.start(), m.end(), _readings(m.group())[1]) for m in _TOKEN.finditer(text) if not m.group().isascii()]
    gains: dict[int, float] = {}
    for _, _, readings in tokens:
        for k, gain, _ in readings:
            gains[k] = gains.get(k, 0.0) + gain * _TRUST.get(PAIRS[k][0], 1.0)
    if not gains:
        return [], None
    best = max(sorted(gains), key=lambda k: gains[k])
    if gains[best] < 0.6:
        return [], None
    return [(a, b, x) for a, b, readings in tokens for k, _, x in readings if k == best], best


def _put(text: str, replaced: Replaced) -> str:
    out, last = [], 0
    for a, b, x in replaced:
        out += [text[last:a], x]
        last = b
    return "".join([*out, text[last:]])


def _extents(old: str, new: str, pair: int | None) -> list[tuple[int, int]]:
    """For each character of new the place in old that it was read from: exactly where the pair's garbled forms add up to old, else equal ends one by one and the middle as a whole."""
    if pair is not None:
        true, wrong = PAIRS[pair]
        try:
            sizes = [len(_garble(ch.encode(true), wrong)) for ch in new]
        except UnicodeEncodeError:
            sizes = []
        if sum(sizes) == len(old):
            ends = list(accumulate(sizes))
            return [(e - n, e) for e, n in zip(ends, sizes, strict=True)]
    short = min(len(old), len(new))
    head = next((i for i in range(short) if old[i] != new[i]), short)
    tail = next((i for i in range(short - head) if old[-1 - i] != new[-1 - i]), short - head)
    middle = [(head, len(old) - tail)] * (len(new) - head - tail)
    return [*((i, i + 1) for i in range(head)), *middle, *((i, i + 1) for i in range(len(old) - tail, len(old)))]


def _moved(places: list[tuple[int, int]], text: str, replaced: Replaced, pair: int | None) -> list[tuple[int, int]]:
    """places (of each character of text in the text as delivered) after the replacement."""
    out, last = [], 0
    for a, b, x in replaced:
        out += places[last:a]
        out += [(places[a + i][0], places[max(a + i, a + j - 1)][1]) for i, j in _extents(text[a:b], x, pair)]
        last = b
    return out + places[last:]


#: Text of a seven-bit encoding that was read as plain characters: everything between its shift sequences.
_SHIFTED = re.compile(r"\x1b\$[@B][!-~]*(?:\x1b[$(][@BIJ][!-~]*)*(?:\x1b\([BJ])?")


def _shifted(m: re.Match) -> str:
    try:
        return m.group().encode("ascii").decode("iso2022_jp")
    except UnicodeDecodeError:
        return m.group()


#: Anomalies from which a token that no pair explains counts as garbled beyond repair.
LOST = 1.6


def _rounds(text: str) -> Iterator[tuple[str, Replaced, int | None, str]]:
    """The replacements that undo a text's misreadings, one round for each: (text before, replaced spans, pair's number, pair). Text can have been misread more than once, and in parts in different ways."""
    shifted = [(m.start(), m.end(), _shifted(m)) for m in _SHIFTED.finditer(text)]
    shifted = [x for x in shifted if x[2] != text[x[0] : x[1]]]
    if shifted:
        yield text, shifted, None, "iso2022_jp>ascii"
        text = _put(text, shifted)
    seen = {text}
    while not text.isascii():
        replaced, pair = _once(text)
        now = _put(text, replaced)
        if pair is None or now in seen:
            return
        yield text, replaced, pair, ">".join(PAIRS[pair])
        seen.add(now)
        text = now


def _lost(token: str) -> bool:
    """Whether a token that no pair explains is garbled beyond repair: lost bytes, or garbled sequences that don't read back with as many anomalies as LOST."""
    return _HARD.search(token) is not None or not token.isascii() and _readings(token)[0] >= LOST and next(iter(automaton().iter(token)), None) is not None


def examine(text: str | None) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text, pairs): pairs in the order in which they were undone, '?' where text stays lost."""
    if text is None:
        return False, None, None
    now, pairs = text, []
    for before, replaced, _, name in _rounds(text):
        now = _put(before, replaced)
        pairs.append(name)
    if not now.isascii() and (_HARD.search(now) or any(map(_lost, _TOKEN.findall(now)))):
        pairs.append("?")
    return bool(pairs), now, "+".join(pairs) or None


def restored_places(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The restored text, and for each of its characters the place (start, end) in the text as delivered; None if nothing was restored."""
    now, places = text, None
    for before, replaced, pair, _ in _rounds(text):
        places = _moved([(i, i + 1) for i in range(len(text))] if places is None else places, before, replaced, pair)
        now = _put(before, replaced)
    return now, places


_SCHEMA = "garbled boolean, restored string, pairs string"


def examined(text: Column) -> Column:
    """struct<garbled, restored, pairs> of a text; texts that repeat within a batch are examined once."""

    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        codes, values = pd.factorize(texts)
        results = [examine(v) for v in values] + [(False, None, None)]
        return pd.DataFrame([results[c] for c in codes], columns=["garbled", "restored", "pairs"])

    return run(text)


#: A text without any of these can't be garbled: the JVM keeps it from Python.
NOT_ASCII = r"[^\x00-\x7f]|\x1b\$"


def garbled_rows(df: DataFrame, key: str, field: str) -> DataFrame:
    """Rows of df whose field is garbled: key, restored, pairs. Rows that are ASCII only never reach Python."""
    x = df.select(key, field).filter(F.col(field).rlike(NOT_ASCII)).withColumn("x", examined(F.col(field)))
    return x.filter("x.garbled").select(key, "x.restored", "x.pairs")


def restored_rows(df: DataFrame, field: str) -> DataFrame:
    """df with field restored where it was garbled and could be; all other rows and columns as they are."""
    return df.withColumn(field, F.when(F.col(field).rlike(NOT_ASCII), examined(F.col(field))["restored"]).otherwise(F.col(field)))
