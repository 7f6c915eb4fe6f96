"""Files that nobody wrote by hand: made by tools, minified or bundled, copied from third parties, or data saved as code.

Copies are found by content: the token stream of a file, without comments, is fingerprinted by winnowing (the least hash of every window of
token k-grams), a fingerprint recurs if it stands in files of several workspaces, and a file whose fingerprints largely recur is a vendored copy, also when it was slightly changed. The other
kinds show in the text itself: marks of generators in the leading comments, however long, lock files, snapshots and maps by their form, density for minified code, the share of literal lines for data,
and numbered repetition for code written by programs. Names and directories alone never decide; which directories a workspace asked to be scanned is not looked at, p6_kind_report only counts them.

Defined cases: files without content (null, empty or blank) are never found. Files with fewer tokens than a k-gram have no fingerprints. Repeated rows are judged each; copies within one workspace don't make a
fingerprint recur. The path may be null. Long files are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import cut

#: Tokens in a k-gram, k-grams in a window: any copied run of K + WINDOW - 1 tokens shares a fingerprint.
K, WINDOW = 28, 8
#: Workspaces in which a fingerprint recurs, and the share of recurring fingerprints that makes a copy.
WORKSPACES, SHARE = 3, 0.5
#: Fingerprints of 8 bytes that are broadcast at most; salts by which the rows of one are spread where there are more.
BROADCAST_PRINTS, SALTS = 1_000_000, 32

_COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?m:^\s*(?://|#(?!!|include|define|if|endif|else)|--|\*).*$)|\"\"\"[\s\S]*?\"\"\"|<!--[\s\S]*?-->")
_TOKENS = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")

# How generators mark their files.
_GENERATED = re.compile(
    r"(?i)@generated\b|\bauto-?\s?generated\b|\bcode generated\b|\bgenerated (?:by|from|on|with|using|automatically|client|code|file)\b|\b(?:produced|created|written|emitted|built|compiled) (?:automatically |mechanically )?by [\w.-]+(?: [\d.]+)? from\b|"
    r"\bregenerate (?:with|by|using)\b|\bthis (?:file|module|class|code) (?:is|was) (?:auto|machine|mechanically|generated|produced)\S*|\bmachine[- ]generated\b|automatisch erzeugt|自動生成"
)
_DO_NOT_EDIT = re.compile(r"DO NOT (?:EDIT|MODIFY|CHANGE)|(?i:\bdo not (?:edit|modify) (?:this file|by hand|manually|directly)\b)")
_BY_HAND = re.compile(r"(?i)\b(?:edit(?:ed)?|written|maintained|kept|change[ds]?) (?:this file |it )?(?:by hand|manually)\b|\bnot (?:auto-?)?generated\b|in sync with the generated|hand-?written")
_HEAD = re.compile(r"^\s*(?://|/\*|\*|#|<!--|--|;|\"\"\"|'''|%|\(\*|REM\b|@)")
#: Block comments, what may stand before the first comment, and single lines.
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "(*": "*)"}
_OPENING = re.compile(r"(?i)<\?|<!doctype|[\"']use strict[\"']")
_LINE = re.compile(r"[^\n]+")
_LOCK = re.compile(r"(?m)^\s*[\"']?lockfileVersion[\"']?\s*:|^# yarn lockfile|^# This file is automatically @generated by (?:Cargo|Poetry)|^\[\[package\]\]\s*\nname = |^GEM\n  remote:|\"_meta\":\s*\{\s*\"hash\"|^PODS:\n")
_MAP = re.compile(r"^\s*(?:\)\]\}'?,?\s*)?\{\s*\"version\"\s*:\s*3\s*,[\s\S]*?\"(?:mappings|sources)\"\s*:")
_SNAPSHOT = re.compile(r"(?m)^exports\[`[\s\S]*?`\]\s*=\s*`|^// (?:Jest|Vitest) Snapshot v\d|^# snapshot: ")
#: Literals and the keys before them; a line of which nothing but punctuation is left without them is data.
_STRIP = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<![\w.])[-+]?\d[\w.+-]*|\b(?:true|false|null|none|nil)\b|\b\w+(?=\s*(?::|=>))", re.I)
_CODE_LEFT = re.compile(r"[^\[\](){},;:=>\s]")
_CALL = re.compile(r"[\w)\]]\s*\(|=>|\breturn\b|;")
_KEYED = re.compile(r"^\s*[\"']?[\w.-]+[\"']?\s*(?::|=)\s*[^{\[]*$")
_NUMBERED = re.compile(r"[A-Za-z_]\d+\b")
_RECORD = re.compile(r"^\s*[{(\[].*[})\]]\s*,?\s*$")
_LICENCE = re.compile(r"(?i)\b(?:licen[cs]ed? under|released under|MIT licen[cs]e|BSD|apache licen[cs]e|\(c\)|copyright)")
_BANNER = re.compile(r"(?i)^\s*(?:/\*!|/\*\*?|//|#)\s*[@\w./-]+\s+v?\d+\.\d+\.\d+")
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|vendors?|third[-_]party|thirdparty|external|extern|deps|\.venv|venv|site-packages|Pods|Carthage)/")
_SETTINGS = re.compile(r"(?i)\.(?:ya?ml|toml|ini|cfg|conf|env|properties|xml|local|production|sh|css|scss|html|md|txt)$|(?:^|/)\.env")


def shape(line: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", line))


def _leading(text: str) -> Iterator[str]:
    """Lines of the comments before the first line that is neither comment nor blank, also those within a block comment."""
    close = None
    for m in _LINE.finditer(text):
        line = m.group()
        start = line.lstrip()
        if close is None:
            if not start.strip() or _OPENING.match(start):
                continue
            mark = next((k for k in _BLOCKS if start.startswith(k)), None)
            if mark is None and not _HEAD.match(line):
                return
            if mark is not None and _BLOCKS[mark] not in start[len(mark) :]:
                close = _BLOCKS[mark]
        elif close in line:
            close = None
        yield line


def evidence(path: str | None, text: str | None) -> str | None:
    """What the text of a file shows by itself: generated, lock, snapshot, map, minified, data, banner, repeated; None if nothing."""
    if text is None or not text.strip():
        return None
    top = text.lstrip("\ufeff")
    head = top.split("\n", 12)[:12]
    for line in (*filter(_HEAD.match, head), *_leading(top)):
        if (_GENERATED.search(line) or _DO_NOT_EDIT.search(line)) and not _BY_HAND.search(line):
            return "generated"
    if _LOCK.search(text) or re.search(r"(?i)(?:^|/)(?:[\w.-]+-lock\.(?:json|ya?ml)|[\w.-]+\.lock)$", path or "") and text.count("integrity") + text.count("resolved") + text.count("checksum") > 3:
        return "lock"
    if _MAP.match(text):
        return "map"
    if _SNAPSHOT.search(text):
        return "snapshot"
    lines = [x for x in text.split("\n") if x.strip()]
    size = sum(map(len, lines))
    blanks = len(text) - sum(map(len, text.split())) - text.count("\n")
    dense = sum(len(x) for x in lines if len(x) >= 200)
    if dense >= 0.7 * size and blanks < 0.14 * size and size >= 300 and not _pem_only(lines):
        return "minified"
    if _is_data(path, text, lines):
        return "data"
    if _is_repeated(path, lines):
        return "repeated"
    if _VENDOR_DIR.search(path or "") and any(_BANNER.match(x) for x in head[:3]) and any(_LICENCE.search(x) for x in head[:5]):
        return "banner"
    return None


def _pem_only(lines: list[str]) -> bool:
    return all("-----BEGIN " in x for x in lines if len(x) >= 200)


def _is_data(path: str | None, text: str, lines: list[str]) -> bool:
    if _SETTINGS.search(path or "") or len(lines) < 6:
        return False
    if re.search(r"(?i)\.(?:csv|tsv)$", path or ""):
        return len(lines) >= 10
    body = [x for x in lines if not _HEAD.match(x)]
    literal, other = [], 0.15 * len(body)  # so many lines of another kind are one too many at most
    for x in body:
        if not _CODE_LEFT.search(_STRIP.sub("", x)) or _RECORD.match(x) and not _CALL.search(x):
            literal.append(x)
        else:
            other -= 1
            if other < -1e-9:
                return False
    if len(body) < 6:
        return False
    keyed = sum(_KEYED.match(x) is not None for x in literal)
    if keyed > 0.5 * len(literal):  # settings: one named value a line
        return False
    amount = sum(map(len, literal))
    shapes = Counter(shape(x.strip()) for x in literal)
    runs = sum(len(x) >= 40 and bool(re.match(r"^\s*[\"'][A-Za-z0-9+/=_-]{30,}[\"']", x)) for x in literal)
    numbers = sum(len(re.findall(r"\d", x)) for x in literal)
    return len(literal) >= 8 and (runs >= 0.5 * len(literal) or numbers >= 0.25 * amount or shapes.most_common(1)[0][1] >= 0.6 * len(literal) and amount >= 300)


def _is_repeated(path: str | None, lines: list[str]) -> bool:
    """Members that differ by a running number only, as programs write them."""
    if _SETTINGS.search(path or "") or (path or "").endswith(".json"):
        return False
    body = [x.strip() for x in lines if not _HEAD.match(x)]
    numbered, other = [], 0.4 * len(body)
    for x in body:
        if _NUMBERED.search(x):
            numbered.append(x)
        else:
            other -= 1
            if other < -1e-9:
                return False
    if len(numbered) < 8:
        return False
    top = Counter(map(shape, numbered)).most_common(3)
    return sum(n for _, n in top) >= 0.8 * len(numbered)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: str | None, k: int = K, window: int = WINDOW) -> list[int]:
    """Winnowed fingerprints of a text's normalised token stream, each once."""
    if not text:
        return []
    tokens = _TOKENS.findall(_COMMENT.sub(" ", text))
    n = len(tokens) - k + 1
    if n < 1:
        return []
    if len(_NUMBERS) > MEMORY:
        _NUMBERS.clear()
    values = _mix(np.fromiter(map(_NUMBERS.__getitem__, tokens), dtype=np.uint64, count=len(tokens)) * np.uint64(0x9E3779B97F4A7C15))
    grams = _mix(_sums(values, k))
    width = min(window, n)
    picked = grams
    while width > 1:  # least of width neighbours, from those of half as many
        half = width // 2
        picked, width = np.minimum(picked[:-half], picked[half:]), width - half
    return np.unique(picked).astype(np.int64).tolist()


class _Numbers(dict):
    """A number for each token; tokens recur, so it is computed once a worker."""

    def __missing__(self, token: str) -> int:
        got = self[token] = zlib.crc32(token.encode()) + 1
        return got


#: Tokens whose numbers are kept; when full, the memory starts anew, which changes no result.
MEMORY = 500_000
_NUMBERS = _Numbers()
_BASE = 0x100000001B3


def _sums(values: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every k neighbours, put together from those of powers of two."""
    out, size, part, length = None, 0, values, 1
    while True:
        if k & length:
            if out is None:
                out, size = part, length
            else:  # the shorter one goes before
                n = len(values) - size - length + 1
                out, size = out[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + part[size : size + n], size + length
        power = 2 * length
        if power > k:
            return out
        n = len(values) - power + 1
        part, length = part[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + part[length : length + n], power



def examined(files: DataFrame) -> DataFrame:
    """Files with content: file_id, workspace, kind (of evidence), prints."""

    @F.pandas_udf("kind string, prints array<bigint>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(evidence(p, t), fingerprints(t)) for p, t in zip(paths, texts, strict=True)], columns=["kind", "prints"])

    f = files.select("file_id", "workspace", "relpath", "content").filter(F.col("content").rlike(r"\S"))
    return f.withColumn("x", run("relpath", "content")).select("file_id", "workspace", "x.kind", "x.prints")


def copies(seen: DataFrame, workspaces: int = WORKSPACES) -> DataFrame:
    """Share of recurring fingerprints of each file that has any: file_id, recurring, prints.

    Only hashes are shuffled; they are combined per workspace before they are counted. The recurring ones are broadcast if a count proves that they are at most BROADCAST_PRINTS, else hot ones are spread by salts."""
    long = seen.select("file_id", F.size("prints").alias("prints"), F.xxhash64("workspace").alias("ws"), F.explode("prints").alias("print"))
    recurring = cut(long.select("print", "ws").distinct().groupBy("print").agg(F.count("*").alias("n")).filter(F.col("n") >= workspaces).select("print"))
    if recurring.limit(BROADCAST_PRINTS + 1).count() <= BROADCAST_PRINTS:
        hits = long.join(F.broadcast(recurring), "print", "left_semi")
    else:
        salted = recurring.select("print", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hits = long.withColumn("salt", F.pmod(F.hash("file_id"), F.lit(SALTS))).join(salted, ["print", "salt"], "left_semi")
    return hits.groupBy("file_id", "prints").agg(F.count("*").alias("hits")).select("file_id", (F.col("hits") / F.col("prints")).alias("recurring"), "prints")


def not_handwritten(seen: DataFrame, workspaces: int = WORKSPACES, share: float = SHARE) -> DataFrame:
    """file_id, kind of the files that nobody wrote by hand; a vendored copy's kind is 'copy' unless its text shows another."""
    c = copies(seen, workspaces).filter(F.col("recurring") >= share).select("file_id", F.lit("copy").alias("copy"))
    both = seen.select("file_id", "workspace", "kind").join(c, "file_id", "left")
    return both.select("file_id", "workspace", F.coalesce(F.when(F.col("kind") == "banner", F.lit("copy")).otherwise(F.col("kind")), "copy").alias("kind")).filter(F.col("kind").isNotNull())
