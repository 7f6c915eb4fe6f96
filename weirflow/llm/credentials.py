"""Credentials in code, settings, commands and comments: the places, and texts in which only the secret values are replaced.

Quoted strings and long tokens are extracted, with the name that each is given where there is one. Shannon entropy, per alphabet (hexadecimal, base64, printable) and against
a threshold that depends on the length, tells secrets from words and identifiers; hashes, identifiers, references and known placeholders are excluded. Formats that name their
issuer, URLs and headers with credentials, key blocks and values that decode to a credential are recognised by their form and then measured the same way.

Defined cases: null and empty texts have no places and come back as they are. Lines end with a line feed. A value written in pieces counts at its first piece, a key block
at its BEGIN line. Repeated rows are judged each. Long texts and lines are read whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "«REDACTED:{}»"

#: Bits per character below which a value of an alphabet is no random string, for 20 characters; less for shorter ones (see threshold).
BITS = {"hex": 3.0, "base64": 3.6, "printable": 3.3}

#: An unnamed value in both cases is words, not a random string, where small letters in runs make up this share and fewer of its characters than this begin a word or a number; one in a single case, where so few change between letters and digits.
WORDS, MIXED_CASE, ONE_CASE = 0.4, 0.35, 0.2
#: Hexadecimal digits of usual hashes.
_HASH_LENGTHS = (32, 40, 56, 64, 96, 128)

#: Characters before the first piece of a split value in which its name is looked for.
LEAD = 2_000

_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[-_. ]?key|apikey|auth(?:[-_. ]?(?:token|key))?|authtoken|bearer|"
    r"(?:access|signing|private|secret|account|storage|master|encryption|license|deploy|service|ledger|client|admin|root|webhook|session|shared|api)[-_. ]?(?:key|secret|pass|token)|pat)"
)
_KEY = rf"(?P<name>[\w.$-]*?{_NAME}(?:[-_.](?:key|value|v?\d+|prod|staging|dev|test|pem|base64|b64))?|[\w.$-]*[-_.]key|[a-z]\w*(?:Key|Pass|Pwd|Secret|Token))"
_QUOTED = r"(?P<q>[\"'`])(?P<value>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"
_BARE = r"(?P<bare>[^\s\"'`<>()\[\]{},;]+)"

# Each pattern has a group name (where a name is given) and value or bare.
_FORMS = [
    ("assign", re.compile(rf"(?<![\w$-])[\"'`]?{_KEY}[\"'`]?\]?\)?(?:\s*:\s*(?:str|string|String|&str)\b)?\s*(?::=|=>|=|:)\s*(?:{_QUOTED}|{_BARE})", re.I)),
    ("pair", re.compile(rf"[\"'`](?:--?)?{_KEY}[\"'`]\s*,\s*(?:value\s*[:=]\s*)?{_QUOTED}", re.I)),
    ("option", re.compile(rf"(?<![\w-])--?{_KEY}(?:=|\s+)(?:{_QUOTED}|{_BARE})", re.I)),
    ("element", re.compile(rf"<{_KEY}>\s*(?P<value>[^<>\s][^<>\n]*?)\s*</", re.I)),
    ("attribute", re.compile(rf"(?:key|name|id)\s*=\s*[\"']{_KEY}[\"']\s+value\s*=\s*{_QUOTED}", re.I)),
    ("said", re.compile(rf"(?<![\w$-]){_KEY}\s+(?:is|was|=|:)\s+(?:{_QUOTED}|{_BARE})", re.I)),
    ("comment", re.compile(rf"(?:#|//|/\*|<!--|--|;|\*)\s*(?:\w+\s+){{0,3}}?{_KEY}\s+{_BARE}\s*(?:\*/|-->)?$", re.I)),
    ("annotated", re.compile(rf"@\w+\(\s*{_QUOTED}\s*\)\s+(?:[\w<>]+\s+)+{_KEY}\b", re.I)),
    ("remark", re.compile(rf"{_QUOTED}\s*[;,)]*\s*(?://|#|/\*|--)\s*{_KEY}\b", re.I)),
]
_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://(?P<user>[^\s:/@\"'`<>]*+):(?P<bare>[^\s/\"'`<>@][^\s\"'`<>]*?)@(?=[\w.\[-])", re.I)
_QUERY = re.compile(rf"[?&;]{_KEY}=(?P<bare>[^\s&\"'`<>#)]+(?:#[\w!?]+)?)", re.I)
_HEADER = re.compile(r"\b(?:Basic|Bearer|Token|ApiKey|Digest)\s+(?P<bare>[^\s\"'`<>,;]{6,})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[\s=]+[\"']?[\w.@-]+:(?P<bare>[^\s\"']+)")
_SSHPASS = re.compile(r"\b(?:password|passwd)\s+(?P<plain>[^\s\"'\\]{6,})|\bsshpass\s+-p\s*[\"']?(?P<bare>[^\s\"']+)|\bmysql\b[^\n]*\s-p(?P<value>[^\s\"'-][^\s\"']*)")
# Formats by which issuers mark their keys.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+=.-])(?P<bare>(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|sk-(?:ant-|proj-|live-|svcacct-)?[0-9A-Za-z_-]{20,}|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{20,}|"
    r"xox[abeoprs]-[0-9A-Za-z-]{10,}|(?:sk|rk|pk|vk|whsec|tok)_(?:live_|test_)?[0-9A-Za-z]{20,}|glpat-[0-9A-Za-z_-]{16,}|npm_[0-9A-Za-z]{30,}|hf_[0-9A-Za-z]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|ya29\.[\w-]{20,}|"
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![A-Za-z0-9_/+=-])"
)
_BLOCK = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]*?)PRIVATE KEY(?: BLOCK)?-----(?P<body>[\s\S]*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?=-----BEGIN )|\Z)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/_-]{16,}={0,2})(?![A-Za-z0-9+/=_-])")
_STRING = re.compile(_QUOTED)
#: A line of nothing but a literal: beside another one it is part of a block of data.
_LITERAL_LINE = re.compile(r"[\s\[({]*(?:[\"'`][A-Za-z0-9+/=_-]{30,}[\"'`]|[A-Za-z0-9+/=_-]{30,})[\s,;+\\.)\]}]*")
_PIECES = re.compile(r"(?P<q>[\"'`])(?P<first>[^\"'`\n]{4,}+)(?P=q)(?P<rest>(?:[ \t]*(?:\+|\\|\.|&|\|\|)?[ \t]*\\?\n[ \t]*(?:\+|\.|&|\|\|)?[ \t]*[\"'`][^\"'`\n]{1,}[\"'`])+)(?P<tail>[^\n]*)")
_CONTINUED = re.compile(r"[\"'`][ \t]*(?:\+|\\|\.|&|\|\|)?[ \t]*\\?\n[ \t]*(?:\+|\.|&|\|\|)?[ \t]*[\"'`]")
_INNER = re.compile(r"[\"'`]([^\"'`\n]+)[\"'`]")
_NAMED_ENTRY = re.compile(rf"^[ \t]*-?[ \t]*name:[ \t]*[\"']?{_KEY}[\"']?[ \t]*\r?\n[ \t]*value:[ \t]*(?:{_QUOTED}|(?P<plain>[^\s\"']+))", re.I | re.M)
_FOLDED = re.compile(rf"^[ \t]*[\"']?{_KEY}[\"']?[ \t]*[:=][ \t]*(?:[|>][+-]?|\\)[ \t]*\r?\n[ \t]+(?P<plain>[^\s\"']+)[ \t]*$", re.I | re.M)

_HAS_VALUE = re.compile(r"^[ \t]*value:", re.M)
_HAS_FOLD = re.compile(r"[:=][ \t]*(?:[|>][+-]?|\\)[ \t]*\r?$", re.M)

#: A line can hold a secret only with letters and digits in one run of characters, or with a long run; all else is left out at once.
_RUN = re.compile(r"[^\s\"'`<>(),;{}\[\]]{6,}")
_DIGIT, _ALPHA = re.compile("[0-9]"), re.compile("[A-Za-z]")

_PLACEHOLDER = re.compile(
    r"(?i)your[-_ ]|<[^>]*>|\$\{|\$\(|\{\{|%\(|%s|«|»|redacted|placeholder|example|changeme|change[-_ ]me|dummy|sample|xxxx|\*{3,}|•{3,}|\.{3}|…|insert|replace|todo|none$|null$|undefined$|true$|false$|n/a$|not[-_ ]?set|fake|foobar|"
    r"test[-_]?key|lorem|_here$|-here$|^<|^\$[A-Za-z_]|^%[A-Za-z_]+%$|^(.)\1+$|^\[|^[-_.]+$|masked|hidden|removed|secret$|password$"
)
_REFERENCE = re.compile(r"(?i)environ|process\.env|getenv|getpass|env\.|secrets?[./:]|vault|^~|^arn:|keyring|kms|ssm|config\.|settings\.|\bself\.|\bthis\.|^sha\d+[:-]|^file:|z\.|^https?://[^@]*$|_DIR\b|prompt|^[A-Z]:\\")
_PATH = re.compile(r"^\.{0,2}/(?:[a-z][a-z0-9_.-]*/?)+$")
_HASHED = re.compile(r"(?i)sha-?\d|md5|digest|checksum|hash|commit|revision|\brev\b|integrity|etag|fingerprint|request[-_ ]?id|trace|uuid|guid|public|pub(?:lic)?[-_ ]?key|data:image|font/|base64,|cert|build[-_ ]?id|blake|crc|image_digest|@sha|\bid\b")
_CODE_REF = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*|\[[^\]]*\])*(?:\(.*)?$")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_NAME_OF_FILE = re.compile(r"(?i)(?:[-_.](?:file|path|dir|env|name|url|uri|id|type|count|length|len|size|limit|ttl|timeout|re|regex|pattern|expiry|expires|field|header|label|mode|policy|index|prefix|suffix|store|ref|hash|digest|bits|min|max|rotation|format|version|required|enabled))$")


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return "hex"
    return "base64" if re.fullmatch(r"[A-Za-z0-9+/_=-]+", value) else "printable"


def threshold(value: str) -> float:
    """Bits per character that a random value of this alphabet and length reaches nearly always: the alphabet's at 20 characters, less below (a short value can't hold more) and a little more above."""
    return BITS[alphabet(value)] * min(1.08, math.log2(max(len(value), 2)) / math.log2(20))


def random_like(value: str) -> bool:
    """A long value with the entropy of a random string that mixes kinds of characters."""
    if len(value) < 16 or entropy(value) < threshold(value):
        return False
    return bool(re.search(r"[0-9]", value)) and bool(re.search(r"[A-Za-z]", value)) and (alphabet(value) == "hex" or bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value)) or len(value) >= 24)


def password_like(value: str) -> bool:
    """A value that a person would set as a password: letters with digits, or with signs and digits; no plain word, number, path or identifier."""
    if len(value) < 6 or not re.search(r"[A-Za-z]", value) or not re.search(r"[0-9]", value) or value.count(" ") > 1:
        return False
    if re.fullmatch(r"v?\d+(?:[._-]\d+)*(?:[a-z]{1,3})?|\d+(?:ms|s|m|h|d|kb|mb|gb|px|em|%)|0x[0-9a-fA-F]+|[0-9.eE+-]+", value):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*[-_.]?\d{1,2}", value) or re.fullmatch(r"[A-Z]+(?:_[A-Z0-9]+)+", value):
        return False
    return entropy(value) >= 2.2


def _decoded(value: str) -> str | None:
    """The text that a base64 value stands for, if it is printable ASCII."""
    if len(value) < 12 or len(value.rstrip("=")) % 4 == 1 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", value):
        return None
    try:
        raw = base64.b64decode(value.rstrip("=").replace("-", "+").replace("_", "/") + "=" * (-len(value.rstrip("=")) % 4))
        text = raw.decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return text if text.isprintable() else None


def encoded_credential(value: str) -> bool:
    """Whether a base64 value stands for user:password."""
    text = _decoded(value)
    m = re.fullmatch(r"[\w.@-]{2,}:(\S{5,})", text) if text else None
    return bool(m) and (password_like(m.group(1)) or random_like(m.group(1)))


def secret_value(value: str, name: str | None, quoted: bool, context: str) -> bool:
    """Whether a value (under a name that speaks of secrets, or under none) is a usable credential."""
    v = value.strip()
    if len(v) < 6 or len(set(v)) < 4 or _PLACEHOLDER.search(v) or _REFERENCE.search(v) or _PATH.match(v) or _UUID.match(v):
        return False
    if name is not None and (_NAME_OF_FILE.search(name) or re.search(r"(?i)public|tokeni[sz]|(?:next|page|cursor)[-_]?token|token[-_]?(?:count|limit|type)|passes|bypass|compass", name)):
        return False
    if not quoted and re.search(r"[()\[\]{}]|=>|->", v):
        return False
    if not quoted and _CODE_REF.match(v) and ("." in v and not re.search(r"[0-9]", v)):
        return False
    if name is None:
        return random_like(v)
    return random_like(v) or password_like(v) or _phrase(v)


def unnamed_secret(value: str, quoted: bool, context: str) -> bool:
    """Whether a value that nothing names is a secret by its entropy alone: no hash of a usual length, no identifier or path."""
    if re.search(r"\s", value) or not random_like(value) or alphabet(value) == "hex" and len(value) in _HASH_LENGTHS:
        return False
    changes = len(re.findall(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])", value)) / (len(value) - 1)
    if re.search(r"[a-z]", value) and re.search(r"[A-Z]", value):
        words = changes < MIXED_CASE and sum(map(len, re.findall(r"[A-Za-z][a-z]{3,}", value))) >= WORDS * len(value)
    else:
        words = changes < ONE_CASE
    return not words and secret_value(value, None, quoted, context)


def _phrase(v: str) -> bool:
    """Long values without digits that still are random (letters in both cases, or with signs)."""
    return len(v) >= 20 and " " not in v and alphabet(v) == "base64" and bool(re.search(r"[a-z]", v)) and bool(re.search(r"[A-Z]", v)) and entropy(v) >= threshold(v) and not re.fullmatch(r"(?:[A-Z]?[a-z]+)+|[A-Za-z]+(?:[-_/][A-Za-z]+)+", v)


def _value(m: re.Match) -> tuple[str, int, int, bool]:
    g = m.groupdict()
    for part in ("value", "bare", "plain"):
        if g.get(part) is not None:
            s, e = m.span(part)
            text = g[part]
            if part != "value":
                cut = len(text.rstrip(",;"))
                text, e = text[:cut], s + cut
            return text, s, e, part == "value"
    return "", 0, 0, False


#: What a line must hold for a form to apply, so that most patterns are not tried at all.
_NEEDS = {"pair": ("\",", "',", "`,", "\" ,"), "option": ("--", " -"), "element": ("</",), "attribute": ("value",), "said": (" is ", " was ", " = ", " : "), "comment": ("#", "//", "/*", "<!--", "--", ";", "*"), "annotated": ("@",), "remark": ("//", "#", "/*", "--")}
_NAME_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "pat")
_OTHER_HINTS = ("://", "akia", "asia", "aida", "aroa", "aiza", "sk-", "sk_", "rk_", "pk_", "vk_", "whsec_", "tok_", "gh", "xox", "eyj", "basic ", "digest ", "base64", "-u ", "--user", "mysql", "glpat", "npm_", "hf_", "sg.", "ya29")
_LONG_RUN = re.compile(r"[^\s\"'`]{16}")


def _line_spans(line: str, named: bool, data: bool = False) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for m in _ISSUED.finditer(line):
        v = m.group("bare")
        if not re.search(r"(?i)example|xxxx|your|(.)\1{7}", v) and entropy(v) >= (3.0 if re.search("[0-9]", v) else 3.6):
            out.append((*m.span("bare"), "key"))
    for m in _URL.finditer(line):
        v = m.group("bare")
        if len(v) >= 4 and not _PLACEHOLDER.search(v) and not v.startswith("$") and (password_like(v) or random_like(v) or _phrase(v)):
            out.append((*m.span("bare"), "url"))
    for rx, kind in ((_QUERY, "url"), (_HEADER, "header"), (_USER, "password"), (_SSHPASS, "password")):
        for m in rx.finditer(line):
            v, s, e, quoted = _value(m)
            if kind == "header" and (encoded_credential(v) or secret_value(v, "bearer", True, line)) or kind != "header" and secret_value(v, m.groupdict().get("name") or "pass", True, line):
                out.append((s, e, kind))
    for form, rx in _FORMS if named else ():
        if form in _NEEDS and not any(n in line for n in _NEEDS[form]):
            continue
        at = 0
        while m := rx.search(line, at):
            v, s, e, quoted = _value(m)
            at = max(m.start() + 1, m.end("name"))
            if form in ("comment", "said") and not (random_like(v) or password_like(v)):
                continue
            if re.search(r"(?i)public", m.group("name")) or re.search(r"(?i)\bsha\d|digest|checksum|commit|integrity", line[max(0, m.start() - 24) : m.start()]):
                continue
            if secret_value(v, m.group("name"), quoted, line) or encoded_credential(v):
                out.append((s, e, "password" if re.search(r"(?i)pass|pwd", m.group("name")) else "key"))
    if not _HASHED.search(line):
        for m in _TOKEN.finditer(line):
            if encoded_credential(m.group()):
                out.append((*m.span(), "encoded"))
            elif not data and unnamed_secret(m.group(), False, line):
                out.append((*m.span(), "key"))
        for m in _STRING.finditer(line) if not data else ():
            if unnamed_secret(m.group("value"), True, line):
                out.append((*m.span("value"), "key"))
    elif "base64" in line:
        for m in _TOKEN.finditer(line):
            if encoded_credential(m.group()):
                out.append((*m.span(), "encoded"))
    return out


def _data_line(text: str, start: int, end: int) -> bool:
    """Whether the line text[start:end] is a literal beside another line of that kind."""
    if not _LITERAL_LINE.fullmatch(text, start, end):
        return False
    before = text.rfind("\n", 0, max(start - 1, 0)) + 1
    after = text.find("\n", end + 1)
    return start > 0 and bool(_LITERAL_LINE.fullmatch(text, before, start - 1)) or end < len(text) and bool(_LITERAL_LINE.fullmatch(text, end + 1, len(text) if after < 0 else after))


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """Places of secret values in a text: (start, end, kind), ordered, not overlapping; of one value in several pieces the later ones have the kind 'more'."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    for m in _BLOCK.finditer(text):
        body = re.sub(r"\\[nr]|[\s\"'+\\,;]", "", m.group("body"))
        if len(body) >= 40 and len(set(body)) > 12 and not _PLACEHOLDER.search(body) and entropy(body) > 4:
            out.append((m.start(), m.end(), "private_key"))
    for m in _PIECES.finditer(text) if _CONTINUED.search(text) else ():
        lead = text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - LEAD) : m.start()]
        pieces = [(m.start("first"), m.end("first")), *((m.start("rest") + a, m.start("rest") + b) for a, b in (p.span(1) for p in _INNER.finditer(m.group("rest"))))]
        whole = "".join(text[a:b] for a, b in pieces)
        named = re.search(rf"{_KEY}[\"'`]?\]?\)?\s*(?::[^=\"']*)?(?::?=|:|,|\()\s*\(?\s*$", lead, re.I) or re.search(rf"(?://|#|/\*|--)\s*{_KEY}\b", m.group("tail"), re.I)
        issued = _ISSUED.fullmatch(whole)
        if issued and entropy(whole) >= 3.0 or named and not _HASHED.search(lead) and secret_value(whole, named.group("name"), True, whole) or encoded_credential(whole):
            out += [(a, b, "more" if i else "key") for i, (a, b) in enumerate(pieces)]
    for rx, sign in ((_NAMED_ENTRY, _HAS_VALUE), (_FOLDED, _HAS_FOLD)):
        for m in rx.finditer(text) if sign.search(text) else ():
            v, s, e, quoted = _value(m)
            if secret_value(v, m.group("name"), True, v) or encoded_credential(v):
                out.append((s, e, "key"))
    end = -1
    for m in _RUN.finditer(text):
        if m.start() < end:
            continue  # a line that was looked at
        run = m.group()
        if not (len(run) >= 20 or _DIGIT.search(run) and _ALPHA.search(run)):
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        line = text[start:end]
        low = line.lower()
        named = any(h in low for h in _NAME_HINTS)
        if len(line) >= 8 and (named or any(h in low for h in _OTHER_HINTS) or _LONG_RUN.search(line)):
            out += [(start + s, start + e, k) for s, e, k in _line_spans(line, named, _data_line(text, start, end))]
    out.sort(key=lambda x: (x[0], -x[1]))
    merged: list[tuple[int, int, str]] = []
    for s, e, k in out:
        if merged and s < merged[-1][1]:
            a, b, kind = merged[-1]
            merged[-1] = (a, max(b, e), kind)
        elif e > s:
            merged.append((s, e, k))
    return merged


def places(text: str | None) -> list[int]:
    """Numbers of the lines (from 1) in which a credential begins."""
    found = spans(text)
    out, at, line = [], 0, 1
    for s, _, kind in found:
        line += text.count("\n", at, s)
        at = s
        if kind != "more":
            out.append(line)
    return sorted(set(out))


def redact(text: str | None) -> str | None:
    """text with the secret values replaced by marks, all else as it is."""
    out, last = [], 0
    for s, e, k in spans(text):
        out += [text[last:s], MARK.format("key" if k == "more" else k)]
        last = e
    return text if not out else "".join([*out, text[last:]])


def _gate() -> str:
    """A pattern, for Java and Python alike, that every text matches in which spans finds anything: the same hints, long runs, key blocks, and strings that go on after a line break."""
    hints = "|".join(map(re.escape, [*_NAME_HINTS, *_OTHER_HINTS, "begin"]))
    return rf"(?i){hints}|[^\s\"'`]{{16}}|[\"'`][ \t]*(?:\+|\\|\.|&|\|\|)?[ \t]*\\?\r?\n[ \t]*(?:\+|\.|&|\|\|)?[ \t]*[\"'`]"


GATE = _gate()


def credential_lines(df: DataFrame, key: str, field: str) -> DataFrame:
    """key, line_no of every line in which a credential begins. Texts without any hint never reach Python."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([places(t) for t in texts], dtype=object)

    x = df.select(key, field).filter(F.col(field).rlike(GATE))
    return x.select(key, F.explode(run(F.col(field))).alias("n")).select(key, F.col("n").cast("long").alias("line_no"))


def redacted(text: Column) -> Column:
    """text with its secret values replaced."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], dtype=object)

    return F.when(text.rlike(GATE), run(F.when(text.rlike(GATE), text))).otherwise(text)
