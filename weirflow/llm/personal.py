"""Personal data in running text: the kinds that occur, and texts in which each item is replaced by a placeholder of its kind.

Generators with high recall propose overlapping spans; boosted trees judge each by its format and its context; thresholds, calibrated on held-out rows, select those to
be replaced. The trees are fitted on a bounded sample of labelled rows that personal_sample.py makes up (SAMPLE_ROWS of them); how often words occur is counted over all rows.
Text that was read in the wrong encoding is judged as restored, and redacted where it stands.

Defined cases: null and empty texts hold nothing and come back as they are. Repeated rows are judged each. Full-width letters and digits count as the plain ones. Long texts are processed whole.
"""

from __future__ import annotations

import copy
import re
import zlib
from bisect import bisect_right
from collections import Counter
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.boosting import BoostedTrees
from weirflow.llm.encoding import restored_places

KINDS = ("email", "phone", "id_number", "street_address", "name")
PLACEHOLDER = "[{}]"
#: Labelled rows that the trees are fitted on.
SAMPLE_ROWS = 12_000
#: A word is frequent if it is in at least this share of the texts; there are at most (words of a text) / FREQUENT such words.
FREQUENT = 0.0005

_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " ", 0xA0: " ", 0x2010: "-", 0x2011: "-", 0x2013: "-", 0x2212: "-"}

# ---- generators -------------------------------------------------------------------------------------------------------------------------
_AT = r"(?:@|\s*[\[({<]\s*(?:at|AT|@|ät|arroba)\s*[\])}>]\s*|\s+(?:at|AT|arroba)\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|DOT|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9](?:[\w+-]|\.(?=[\w+-]))*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_À-ÿ])(?:\+|\(\+?)?\d(?:\d|(?:[ .()/-]|\) | \(| - )(?=[\d(])){5,22}\d(?![A-Za-z0-9_À-ÿ])")
_ID = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])(?![\w-])")
_LETTER = r"[A-Za-zªºÀ-ÖØ-öø-ɏͰ-ӿḀ-ỿ\u0300-\u036f]"
_W = rf"{_LETTER}+(?:['’.-]{_LETTER}+)*"
_SUFFIX = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Row|Drive|Dr|Court|Ct|Place|Pl|Way|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Parkway|Hill|Gardens|Mews|Walk)"
_ADDRESS = [
    re.compile(rf"(?<![\w-])\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}{_SUFFIX}\b\.?(?:,? (?:Apt|Flat|Unit|Suite|No)\.? ?\w+)?(?:, [A-ZÀ-Þ]\w+)?"),
    re.compile(rf"(?<![\w-])[A-ZÀ-Þ][\w'’]*(?: [A-ZÀ-Þ][\w'’]*){{0,2}} (?:(?:St|Rd|Ave|Ln|Dr|Ct|Pl|Sq|Blvd)\.?|Street|Road|Avenue|Lane|Close|Row|Drive|Court|Place|Square|Terrace|Crescent|Boulevard) \d{{1,5}}[A-Za-z]?\b(?:,? (?:Apt|Flat|Unit|Suite|No)\.? ?\w+)?(?:, [A-ZÀ-Þ]\w+)?"),
    re.compile(r"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof) \d{1,4} ?[a-z]?\b(?:, \d{5} [A-ZÄÖÜ]\w+)?"),
    re.compile(r"(?<![\w-])\d{1,4}(?: ?bis| ?ter)?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route) (?:(?:de|du|des|la|le|les)\s+|[ld]['’]\s?)*[\w'’-]+(?:, \d{5} [A-ZÀ-Þ]\w+)?", re.I),
    re.compile(r"(?<![\w-])(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrer|rua|travessa|largo|praça|via|viale|piazza|ulica|ul\.|улица|ул\.|проспект|пр\.) ?(?:(?:de|del|la|las|los|do|da|dos|das) )*[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*){0,2},? ?(?:nº ?|n\.º ?|д\. ?)?\d{1,4}(?:,? \d{1,2}\.?[ºªo°] ?[A-Za-z]?\b)?", re.I),
    re.compile(r"(?<!\w)(?:P\.? ?O\.? ?Box|Post(?:al)? Box|Postfach|Boîte postale|BP|Apartado(?: de correos)?|Caixa postal|私書箱|а/я) ?\d{1,6}(?:,? [A-ZÀ-Þ][\w]+)?", re.I),
    re.compile(r"(?:〒\s?\d{3}-?\d{4}\s?)?[一-鿿぀-ヿ]{1,6}[都道府県][一-鿿々ヶ゠-ヿ぀-ゟ]{1,14}?(?:[市区町村郡])?[一-鿿々ヶ゠-ヿ]*\s?\d{1,4}(?:[-－の丁目番地号]{1,3}\d{1,4}){0,3}号?"),
    re.compile(r"[一-鿿々ヶ]{1,5}[市区町村][一-鿿々ヶ゠-ヿ]{1,8}\s?\d{1,3}(?:[-－丁目番地]{1,3}\d{1,4}){1,3}"),
]
_RUN = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*\.?")
_HAN_NAME = re.compile(r"[一-鿿々]{1,4}(?:[  　][一-鿿々]{1,3})?")
_KATAKANA_NAME = re.compile(r"[゠-ヺー]{2,8}(?:[ 　・][゠-ヺー]{2,8})?")
_HONORIFIC = re.compile(r"\s?(?:様|さん|君|くん|ちゃん|先生|氏|殿|さま|選手|教諭)")

# Words of context.
TITLES = frozenset("mr mrs ms miss mx dr prof sir madam herr frau fräulein mme mlle madame monsieur m sr sra srta don doña señor señora dona senhor senhora professor professora coach nurse г-н г-жа господин госпожа".split())
RELATIVES = frozenset("mother father mum mom dad aunt uncle cousin brother sister grandmother grandfather guardian parent son daughter neighbour neighbor friend mutter vater tante onkel oma opa mère père tante oncle soeur frère madre padre tía tío abuela abuelo hermano hermana mãe pai avó tia tio мама мамой мать отец бабушка тётя сестра брат".split())
THINGS = frozenset(
    "school college university academy museum cup reader hill house lighthouse library gallery park theatre theater stadium festival award prize club team league tournament competition exam test chapter unit page room course group class book novel street road avenue lane river lake mountain bridge station airport hospital church institute "
    "centre center company trust day week month monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december hall tower press journal edition series project programme program museums trip english french german spanish maths math science history".split())  # fmt: skip
#: Signs that join a word to what stands before or after it: parts of addresses, names of files and numbers are no names in small letters.
_JOINED, _JOINED_AFTER = "@._/#+0123456789", ("@", "_", "/", "#", "+", *"0123456789")
#: Signs after which a sentence or an item of a list starts.
_STOPS = frozenset(".!?。！？:;/•|\"“»(「『")
_PIECE = re.compile(r"[^\W\d_][\w'’]*|\d+|\s+|[^\w\s]+|_+")


def plain(text: str) -> str:
    """text with wide letters, digits and blanks as the plain ones; every place stays where it is."""
    return text if text.isascii() else text.translate(_WIDE)


class _Text:
    """A plain text with what its candidates' features share: words, pieces (words, numbers, signs, blanks), and the surroundings of each place, looked at once."""

    __slots__ = ("after", "before", "frequent", "pieces", "starts", "t", "words")

    def __init__(self, t: str, frequent: frozenset[str]) -> None:
        self.t, self.frequent = t, frequent
        self.before: dict[int, tuple] = {}
        self.after: dict[int, tuple] = {}
        self.words = [(m.start(), m.end(), m.group()) for m in _RUN.finditer(t)]
        self.pieces: list[str] | None = None

    def _piece(self, at: int) -> int:
        """Number of the piece that at stands in; the pieces are cut when first asked for."""
        if self.pieces is None:
            self.pieces = _PIECE.findall(self.t)
            self.starts = [0, *accumulate(map(len, self.pieces))]
        return bisect_right(self.starts, at) - 1

    def left(self, s: int) -> tuple:
        """Word before, signs before, whether a sentence starts here, whether a capital word stands right before, the character before."""
        got = self.before.get(s)
        if got is None:
            i, t = self._piece(s), self.t
            pieces, part = self.pieces, t[self.starts[i] : s]
            signs, stop, more = "", s == 0, False
            if part:
                word = part
            else:
                k = i - 1
                more = i > 1 and pieces[k] in (" ", "-") and (pieces[i - 2][0].isupper() or "゠" <= pieces[i - 2][-1] <= "ヺ" or "一" <= pieces[i - 2][-1] <= "鿿")
                if k >= 0 and pieces[k].isspace():
                    stop = stop or "\n" in pieces[k]
                    k -= 1
                if k >= 0 and not pieces[k][0].isalnum():
                    signs = pieces[k]
                    stop = stop or signs[-1] in _STOPS or signs in ("-", "–", "—") and (k == 0 or pieces[k - 1].isspace())
                    k -= 1
                    if k >= 0 and pieces[k].isspace():
                        k -= 1
                stop = stop or k < 0
                word = pieces[k] if k >= 0 and pieces[k][0].isalpha() else ""
            word = word[-1] if word and word[-1] > "⺀" else word.lower()  # scripts without blanks between words
            got = self.before[s] = (word, signs, stop, more, t[s - 1] if s else "")
        return got

    def right(self, e: int) -> tuple:
        """Signs after, word after, whether a capital word follows, whether an honorific does, whether the text ends, the character after."""
        got = self.after.get(e)
        if got is None:
            i, t = self._piece(e), self.t
            pieces, signs, word, more = self.pieces, "", "", False
            if i < len(pieces):
                part = t[e : self.starts[i + 1]]
                if self.starts[i] == e:
                    k = i
                    more = i + 1 < len(pieces) and part in (" ", "-") and (pieces[i + 1][0].isupper() or "゠" <= pieces[i + 1][0] <= "ヺ" or "一" <= pieces[i + 1][0] <= "鿿")
                    if not part[0].isalnum() and not part.isspace():
                        signs = part
                        k += 1
                    if k < len(pieces) and pieces[k].isspace():
                        k += 1
                    word = pieces[k] if k < len(pieces) and pieces[k][0].isalnum() else ""
                else:
                    word = part
                word = word[:2] if word and word[0] > "⺀" else word.lower()
            got = self.after[e] = (signs, word, more, _HONORIFIC.match(t, e) is not None, not t[e : e + 40].strip(" .)>"), t[e : e + 1])
        return got


def _names(x: _Text):
    t, frequent = x.t, x.frequent
    words = [w for w in x.words if w[1] - w[0] - w[2].endswith(".") > 1 or w[2][0].isupper() and w[2].endswith(".")]
    small = [w for w in words if len(w[2]) > 2 and w[2][0].islower() and not (t[w[0] - 1 : w[0]] in _JOINED and w[0]) and t[w[1] : w[1] + 1] not in _JOINED_AFTER]
    rare = {w[0] for w in small if w[2].rstrip(".") not in frequent}
    before = dict(zip([w[0] for w in x.words[1:]], x.words, strict=False))
    for s, e, w in small:
        if s in rare or s in before and before[s][2].rstrip(".").lower() in TITLES and s - before[s][1] <= 2:
            yield s, e - w.endswith(".")
    for a, b in zip(small, small[1:], strict=False) if rare else ():
        if (a[0] in rare or b[0] in rare) and a[1] + 1 == b[0] and t[a[1]] == " ":
            yield a[0], b[1] - b[2].endswith(".")
    runs: list[list] = []
    for w in words:
        if not w[2][0].isupper():
            continue
        last = runs[-1][-1] if runs else None
        follows = last is not None and last[1] + 1 == w[0] and t[last[1]] == " "
        if follows and (not last[2].endswith(".") or len(last[2]) == 2) and len(runs[-1]) < 6:
            runs[-1].append(w)
        else:
            runs.append([w])
    for run in runs:
        for i in range(len(run)):
            for j in range(i, min(len(run), i + 3)):
                end = run[j][1] - run[j][2].endswith(".")
                if t[end - 2 : end] in ("'s", "’s"):
                    end -= 2
                if end - run[i][0] > 1:
                    yield run[i][0], end
    if t.isascii():
        return
    for m in _HAN_NAME.finditer(t):
        s, e = m.span()
        yield s, e
        after = _HONORIFIC.match(t, e)
        text = m.group()
        for cut in (1, 2):
            if len(text) - cut >= 2 and _HONORIFIC.match(t, e - cut):
                yield s, e - cut
        for k in range(1, len(text) - 1):  # a run of ideographs may begin before the name
            if after and len(text) - k >= 2:
                yield s + k, e
    for m in _KATAKANA_NAME.finditer(t):
        yield m.span()


def candidates(t: str, frequent: frozenset[str] = frozenset(), kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """Spans proposed for the kinds in a plain text, overlapping."""
    return _candidates(_Text(t, frequent), kinds)


def _candidates(x: _Text, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    t, out = x.t, []
    if "email" in kinds and ("@" in t or _AT_WORD.search(t)):
        out += [(*m.span(), "email") for m in _EMAIL.finditer(t)]
    if _DIGIT.search(t):
        for m in _NUMBER.finditer(t):
            s, e = m.span()
            if t[s] == "(" and ")" not in t[s:e]:
                s += 1
            if 7 <= sum(map(str.isdigit, t[s:e])) <= 15:
                out += [(s, e, k) for k in ("phone", "id_number") if k in kinds]
        if "id_number" in kinds:
            out += [(*m.span(), "id_number") for m in _ID.finditer(t)]
        if "street_address" in kinds:
            for rx in _ADDRESS:
                out += [(*m.span(), "street_address") for m in rx.finditer(t)]
    if "name" in kinds:
        out += [(s, e, "name") for s, e in _names(x)]
    return list(dict.fromkeys(out))


_AT_WORD = re.compile(r"(?i)\bat\b|\bät\b|arroba")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*(?:['’-][^\W\d_]+)*")

# ---- features ---------------------------------------------------------------------------------------------------------------------------
_ARTICLES = frozenset("the der die das den dem le la les el los las o a an ein eine une un una um uma".split())
_URL_BEFORE = re.compile(r"(?:https?://|www\.)\S*$")
_PHONE_BEFORE = re.compile(r"(?:tel|tél|tfno|phone|call|dial|text|mobil\w*|móvil|telem\w+|handy|cell|fax|ruf|whatsapp|☎|電話|携帯|連絡は|тел|звонить)\W*$")
_ID_BEFORE = re.compile(r"(?:\bid\b|id no|id card|ssn|social security|passport|passeport|pasaporte|passaporte|pass|ausweis|national|personal|identity|identité|insurance|nino|tax|fiscal|steuernummer|マイナンバー|個人番号|旅券\w*|паспорт|инн|dni|nie|nif|carte)\W*(?:no|n°|nr|num|number)?\W*$")
_SSN, _FOURS, _BOOK = re.compile(r"\d{3}-\d{2}-\d{4}"), re.compile(r"\d{4}[ -]?\d{4}[ -]?\d{4}"), re.compile(r"97[89][ -]")
_DATE = re.compile(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])\b|\b\d{1,2}[./]\d{1,2}[./](?:19|20)\d\d")
_GROUPS, _CAPITAL = re.compile(r"\d+"), re.compile("[A-Z]")
#: Candidates of one family are judged by one forest.
FAMILY = {"phone": "number", "id_number": "number", "email": "email", "street_address": "street_address", "name": "name"}


def _cues(x: _Text, s: int, e: int, kind: str, model: Model) -> tuple:
    wb, sb, stop, _, pb = x.left(s)
    sa, wa, _, _, end, pa = x.right(e)
    return model.cue("b", kind, wb), model.cue("a", kind, wa), model.cue("sa", kind, sa[:1] or "_"), model.cue("sb", kind, sb[-1:] or "_"), stop, end, wb != "", wa != "", pb.isalnum() or pb == "-" or pb == "_", pa.isalnum() or pa == "-" or pa == "_"


def _number_features(x: _Text, s: int, e: int, kind: str, model: Model) -> tuple:
    v = x.t[s:e]
    groups = _GROUPS.findall(v)
    sizes = [*map(len, groups)]
    near = x.t[max(0, s - 40) : s].lower()
    return (
        kind == "phone", len(v), sum(sizes), len(sizes), sizes[0], sizes[-1], max(sizes), min(sizes), v[0] == "+", v[:2] == "00", "(" in v, v.count("-"), v.count(" "), v.count("."), "/" in v, v[0] == "0", _SSN.fullmatch(v) is not None, _FOURS.fullmatch(v) is not None,
        _BOOK.match(v) is not None, _DATE.search(v) is not None, _CAPITAL.search(v) is not None, v[0].isalpha(), v[-1].isalpha(), "://" in near and _URL_BEFORE.search(x.t[max(0, s - 60) : s]) is not None, _PHONE_BEFORE.search(near) is not None, _ID_BEFORE.search(near) is not None, groups[0] == "1", *_cues(x, s, e, kind, model),
    )


def _email_features(x: _Text, s: int, e: int, kind: str, model: Model) -> tuple:
    v = x.t[s:e]
    at = v.find("@")
    last = v[max(v.rfind("."), v.rfind(" ")) + 1 :]
    return len(v), at, v.count(" "), v.count("."), len(last), at >= 0, "(" in v or "[" in v or "<" in v or "{" in v, v.isupper(), sum(map(str.isdigit, v)), last.isalpha(), last.isalpha() and len(last) >= 2, *_cues(x, s, e, kind, model)


def _address_features(x: _Text, s: int, e: int, kind: str, model: Model) -> tuple:
    v = x.t[s:e]
    words = _WORD.findall(v)
    low = [w.lower() for w in words]
    digits = _GROUPS.findall(v)
    return len(v), len(words), len(digits), max(map(len, digits), default=0), v[:1].isdigit(), v[:1].isupper(), v[-1:].isdigit(), "," in v, _script(words), any(w in THINGS for w in low), sum(w in x.frequent for w in low) / max(1, len(low)), *_cues(x, s, e, kind, model)


def _script(words: list[str]) -> int:
    c = words[0][0] if words else ""
    return 0 if not c else 1 if c <= "ɏ" else 2 if "Ѐ" <= c <= "ӿ" else 3 if "一" <= c <= "鿿" else 4


def _name_features(x: _Text, s: int, e: int, kind: str, model: Model) -> tuple:
    v = x.t[s:e]
    words = v.split() if " " in v or "　" in v else [v]
    low = [w.lower().rstrip(".") for w in words]
    known = [w in x.frequent for w in low]
    script = _script(words)
    wb, sb, stop, more_left, pb = x.left(s)
    sa, wa, more_right, honorific, end, pa = x.right(e)
    cue = model.cue
    joined = "".join(words) if script >= 3 else ""
    thing = wa in THINGS or wa.rstrip("s") in THINGS
    return (
        len(v), len(words), script, v.islower(), v.isupper() and len(v) > 2, sum(known) / len(known), known[0], known[-1], wb in TITLES, low[0] in TITLES, wb in RELATIVES, low[0] in RELATIVES, thing, any(w in THINGS for w in low), wb in THINGS, len(low[0]), len(low[-1]), "-" in v, "'" in v or "’" in v,
        more_left, more_right, honorific, wb in _ARTICLES, pb in "'\"“«「『‘" and pb != "", pa in "'\"”»」』’" and pa != "", pb in "@./_#" and pb != "", pa in "@/_#" and pa != "", wb in x.frequent, wa in x.frequent, sb[-1:] == ",", sa[:1] == ",", sa[:1] == "(", sb[-1:] == "(", sb[-1:] in (":", "："), len(joined), "の" in pa, pb > "⺀", pa > "⺀",
        cue("h", kind, joined[:1]) if script == 3 else 0.0, cue("h2", kind, joined[1:2]) if script == 3 else 0.0, cue("l2", kind, joined[-2:-1]) if script == 3 else 0.0, cue("l", kind, joined[-1:]) if script == 3 else 0.0, cue("e", kind, low[-1][-3:]) if script in (1, 2) else 0.0, cue("w", kind, low[0]) if script in (1, 2) else 0.0, *_cues(x, s, e, kind, model),
    )


_FEATURES = {"number": _number_features, "email": _email_features, "street_address": _address_features, "name": _name_features}


#: Texts of at most so many characters are remembered with their result, and at most so many texts and candidates; then the memory starts anew, which changes no result.
REMEMBERED_CHARS, MEMORY = 500, 100_000


class Model:
    """Frequent words, cue rates, trees and thresholds. cue rates: how often, in the sample, a candidate of a kind with a certain neighbour (or, for names, part) is of the kind (smoothed)."""

    def __init__(self) -> None:
        self.frequent: frozenset[str] = frozenset()
        self.rates: dict[tuple[str, str, str], float] = {}
        self.prior: dict[str, float] = {}
        self.trees: dict[str, BoostedTrees] = {}
        self.thresholds: dict[str, float] = {}
        self.known: dict[tuple, float] = {}

    def cue(self, side: str, kind: str, word: str) -> float:
        got = self.rates.get((side, kind, word))
        return self.prior[kind] if got is None else got

    def with_frequent(self, words: frozenset[str]) -> Model:
        """The model for a corpus in which these words are frequent."""
        m = copy.copy(self)
        m.frequent, m.known = self.frequent | words, {}
        return m

    def judge(self, texts: list[str], kinds: tuple[str, ...] = KINDS) -> list[list[tuple[int, int, str, float]]]:
        """Selected spans of plain texts: (start, end, kind, probability), not overlapping, ordered."""
        rows: dict[str, list[tuple]] = {f: [] for f in _FEATURES}
        owners: dict[str, list[tuple]] = {f: [] for f in _FEATURES}
        chosen: dict[int, list] = {}
        known, asked = self.known, {}
        if len(known) > MEMORY:
            known.clear()

        def choose(i: int, s: int, e: int, k: str, q: float) -> None:
            if q >= self.thresholds[k]:
                chosen.setdefault(i, []).append((s, e, k, q))

        for i, t in enumerate(texts):
            x = _Text(t, self.frequent)
            for s, e, k in _candidates(x, kinds):
                f = FAMILY[k]
                if k == "name":  # judged by its words and its surroundings alone, which recur
                    key = (t[s:e], x.left(s), x.right(e))
                    if key in known:
                        choose(i, s, e, k, known[key])
                        continue
                    same = asked.setdefault(key, [])
                    same.append((i, s, e))
                    if len(same) > 1:
                        continue
                    i_or_key = key
                else:
                    i_or_key = i
                rows[f].append(_FEATURES[f](x, s, e, k, self))
                owners[f].append((i_or_key, s, e, k))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for f, mine in rows.items():
            if mine:
                for (i, s, e, k), q in zip(owners[f], self.trees[f].probability(np.asarray(mine, dtype=float)).tolist(), strict=True):
                    if k == "name":
                        known[i] = q
                        for place in asked[i]:
                            choose(*place, k, q)
                    else:
                        choose(i, s, e, k, q)
        for i, spans in chosen.items():
            taken: list[tuple[int, int, str, float]] = []
            for x in sorted(spans, key=lambda x: (-(x[3] + 0.02 * (x[1] - x[0]) ** 0.5 + (0.3 if x[2] in ("email", "street_address") else 0)), x[0])):
                if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
                    taken.append(x)
            out[i] = sorted(taken)
        return out


def _cue_rates(data: list[tuple[_Text, int, int, str, bool]]) -> tuple[dict, dict]:
    seen: dict[tuple[str, str, str], list[int]] = {}
    per: dict[str, list[int]] = {k: [0, 0] for k in KINDS}
    for x, s, e, k, y in data:
        wb, sb, *_ = x.left(s)
        sa, wa, *_ = x.right(e)
        keys = [("b", k, wb), ("a", k, wa), ("sa", k, sa[:1] or "_"), ("sb", k, sb[-1:] or "_")]
        if k == "name":
            words = x.t[s:e].split()
            script = _script(words)
            if script == 3:
                joined = "".join(words)
                keys += [("h", k, joined[:1]), ("h2", k, joined[1:2]), ("l2", k, joined[-2:-1]), ("l", k, joined[-1:])]
            elif script in (1, 2):
                keys += [("e", k, words[-1].lower().rstrip(".")[-3:]), ("w", k, words[0].lower().rstrip("."))]
        for key in keys:
            c = seen.setdefault(key, [0, 0])
            c[0] += y
            c[1] += 1
        per[k][0] += y
        per[k][1] += 1
    prior = {k: (a + 1) / (n + 2) for k, (a, n) in per.items()}
    return {key: (a + 4 * prior[key[1]]) / (n + 4) for key, (a, n) in seen.items() if n >= 3}, prior


def _hit(s: int, e: int, k: str, gold: list[tuple[int, int, str]]) -> bool:
    if k == "name":
        return any(g == k and (s, e) == (a, b) for a, b, g in gold)
    return any(g == k and s < b and a < e and min(e, b) - max(s, a) >= 0.6 * (b - a) for a, b, g in gold)


#: Sides of the cues that are words or parts of a name, not signs.
_WORD_CUES = frozenset(("b", "a", "w", "e", "h", "h2", "l2", "l"))


@cache
def fitted(rows: int = SAMPLE_ROWS) -> Model:
    """The model, fitted on a made-up labelled sample and calibrated on as much again as a quarter of it, held out. The frequent words are to be set per corpus."""
    from weirflow.llm.personal_sample import labelled

    model = Model()
    sample = labelled(rows, seed=11)
    held = labelled(rows // 4, seed=12)
    least = max(3, FREQUENT * len(sample))
    counts, ordinary = Counter(), Counter()
    for t, gold in sample:
        counts.update({w.lower() for w in _WORD.findall(plain(t))})
        ordinary.update({m.group().lower() for m in _WORD.finditer(plain(t)) if not any(a < m.end() and m.start() < b for a, b, _ in gold)})
    known = frozenset(w for w, n in counts.items() if n >= least)  # as in a corpus in which some names are frequent
    fewer = frozenset(w for w in known if zlib.crc32(w.encode()) % 2)  # as in one with words that the sample doesn't have
    model.frequent = frozenset(w for w, n in ordinary.items() if n >= least)

    def spread(part):
        out = []
        for t, gold in part:
            x = _Text(plain(t), fewer if zlib.crc32(t.encode()) % 8 < 2 else known)
            out += [(x, s, e, k, _hit(s, e, k, gold)) for s, e, k in _candidates(x)]
        return out

    data = spread(sample)
    half = data[: len(data) // 2]
    model.rates, model.prior = _cue_rates(half)  # cues from one half, trees from the other, so that the trees don't trust them too much
    blind = copy.copy(model)  # for half of the texts the words around a candidate are unknown, as those of another corpus are
    blind.rates = {key: r for key, r in model.rates.items() if key[0] not in _WORD_CUES}
    check = spread(held)
    for family, features in _FEATURES.items():
        mine = [d for d in data[len(half) :] if FAMILY[d[3]] == family]
        rows_of = lambda part: np.asarray([features(*d[:4], blind if zlib.crc32(d[0].t.encode()) % 2 else model) for d in part], dtype=float)
        model.trees[family] = BoostedTrees().fit(rows_of(mine), np.asarray([float(d[4]) for d in mine]))
        kept = [d for d in check if FAMILY[d[3]] == family]
        p = model.trees[family].probability(rows_of(kept))
        for kind in (k for k in KINDS if FAMILY[k] == family):
            model.thresholds[kind] = _threshold([(q, d[4]) for q, d in zip(p, kept, strict=True) if d[3] == kind])
    return model


def _threshold(judged: list[tuple[float, bool]]) -> float:
    """The probability from which on candidates are selected: the best F1 on held-out rows, of equal ones the nearest to a half."""
    best = (-1.0, 0.5)
    for c in np.linspace(0.2, 0.8, 25):
        tp = sum(y for q, y in judged if q >= c)
        fp = sum(not y for q, y in judged if q >= c)
        fn = sum(y for q, y in judged if q < c)
        f1 = 2 * tp / max(1, 2 * tp + fp + fn)
        if f1 > best[0] + 1e-9 or abs(f1 - best[0]) < 1e-9 and abs(c - 0.5) < abs(best[1] - 0.5):
            best = (f1, float(c))
    return best[1]


# ---- over tables ------------------------------------------------------------------------------------------------------------------------
def frequent_words(texts: DataFrame, share: float = FREQUENT) -> frozenset[str]:
    """Words (lower case) that stand in at least this share of all texts (column text). Counted over all texts; what reaches the driver has at most (mean words of a text) / share entries."""
    per = texts.select(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}+)*"), F.lit(0))).alias("w"))
    total = texts.count()
    rows = per.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(3, share * total)).collect()
    return frozenset(r.w for r in rows)


def _spans(texts: list[str], model: Model, kinds: tuple[str, ...]) -> list[list[tuple[int, int, str]]]:
    """Spans of the items in texts as delivered, (start, end, kind). A garbled text is judged as restored, and its spans are those of the restored characters."""
    restored, places = [], []
    for v in texts:
        r, p = restored_places(v) if not v.isascii() or "\x1b$" in v else (v, None)
        restored.append(plain(r))
        places.append(p)
    return [[(s, e, k) if p is None else (p[s][0], p[e - 1][1], k) for s, e, k, _ in spans] for spans, p in zip(model.judge(restored, kinds), places, strict=True)]


def _judge_each(texts: pd.Series, known: dict, model: Model, kinds: tuple[str, ...], result, null=None) -> list:
    """result(text, spans) of each text, null for nulls; every distinct text of a task is judged once as long as the memory holds it."""
    values = texts.tolist()
    new = list({v for v in values if isinstance(v, str) and v not in known})
    got = {v: result(v, spans) for v, spans in zip(new, _spans(new, model, kinds), strict=True)}
    out = [got[v] if v in got else known.get(v) if isinstance(v, str) else null for v in values]
    if len(known) > MEMORY:
        known.clear()
    known.update((v, x) for v, x in got.items() if len(v) <= REMEMBERED_CHARS)
    return out


def kinds_found(text: Column, frequent: frozenset[str], kinds: tuple[str, ...] = KINDS, rows: int = SAMPLE_ROWS) -> Column:
    """array<string> of those of the kinds that occur in a text; none for null."""
    model = fitted(rows).with_frequent(frequent)
    known: dict = {}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_judge_each(texts, known, model, kinds, lambda _, spans: sorted({k for _, _, k in spans}), []), dtype=object)

    return run(text)


def _put_placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for s, e, k in spans:
        out += [text[last:s], PLACEHOLDER.format(k.upper())]
        last = max(e, last)
    return "".join([*out, text[last:]])


def replaced(text: Column, frequent: frozenset[str], kinds: tuple[str, ...] = KINDS, rows: int = SAMPLE_ROWS) -> Column:
    """text with each item of the kinds replaced by its placeholder, the rest as it was delivered."""
    model = fitted(rows).with_frequent(frequent)
    known: dict = {}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_judge_each(texts, known, model, kinds, _put_placeholders), dtype=object)

    return run(text)
