"""Texts made safe to deliver: redaction, replaced literals, stable pseudonyms, sanitised settings, chunks, de-identified prose and JSON.

Null texts stay null. A redaction of a redacted text changes nothing. Replacements keep everything around them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.text import java
from weirflow.operators.detect import DETECTORS, ENTROPY_FROM, KEY_HINT, LONG_TOKEN, SIGNS, TOKENS_A_LINE

PEM = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"
# Shapes of personal data in the order in which they are replaced, with their tokens.
SHAPES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "EMAIL"),
    ("my-number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "GOVID"),
    ("credit-card", r"\b(?:[0-9]{4}[ -]){3}[0-9]{3,4}\b", "CARDNO"),
    ("phone", r"(?:\+81[ -]?|\b0)[0-9]{1,4}[ -][0-9]{2,4}[ -][0-9]{3,4}\b", "PHONE"),
    ("passport-number", r"\b[A-Z]{2}[0-9]{7}\b", "PASSPORT"),
)
# Names of settings whose values are secret, names whose values are harmless, and the start of a key block, which is never harmless.
SENSITIVE_NAME = r"(?i)(KEY|TOKEN|SECRET|PASSWORD|PASSWD|PRIVATE|CREDENTIAL|AUTH|COOKIE|SESSION|DATABASE_URL|DB_URL|CONNECTION_STRING)"
SAFE_NAME = r"(?i)(^|_)(MODEL|PORT|DEBUG|LOG_LEVEL|NODE_ENV|APP_ENV|ENVIRONMENT|HOST|REGION|PROJECT|PROJECT_ID|APP_NAME|SERVICE_NAME|TIMEOUT|RETRIES|FEATURE_FLAG)(_|$)"
KEY_BLOCK = "-----BEGIN [A-Z ]+PRIVATE KEY-----"


def redacted(text: Column) -> Column:
    """text with every value in a known format replaced by a mark of its category. The earlier pattern of the list has a value that several match."""
    out = text
    for _, category, _, p in DETECTORS:
        out = F.regexp_replace(out, java(p), f"«REDACTED:{category}»")
    return F.when(text.rlike("|".join(SIGNS)), out).otherwise(text)


def merged_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans (start, end, label) in order; those that overlap or touch become one with the label of the first."""
    out: list[tuple[int, int, str]] = []
    for s, e, label in sorted(spans, key=lambda x: x[:2]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2])
        else:
            out.append((s, e, label))
    return out


def secret_spans(text: str, threshold: float = ENTROPY_FROM) -> list[tuple[int, int, str]]:
    """Places of a text with a value in a known format, or a random token on a secret-like line, merged; labels are categories."""
    spans = [(*m.span(), category) for rx, category, sign in _COMPILED if sign.search(text) for m in rx.finditer(text)]
    at = 0
    for line in text.split("\n"):
        if len(line) >= 24 and _HINT.search(line):
            for _, m in zip(range(TOKENS_A_LINE), _LONG.finditer(line), strict=False):
                counts, n = Counter(m.group()).values(), m.end() - m.start()
                if -sum(c / n * math.log2(c / n) for c in counts) >= threshold:
                    spans.append((at + m.start(), at + m.end(), "high-entropy-string"))
        at += len(line) + 1
    return merged_spans(spans)


_COMPILED = [(re.compile(p, re.A), category, re.compile(sign)) for (_, category, _, p), sign in zip(DETECTORS, SIGNS, strict=True)]
_HINT, _LONG = re.compile(KEY_HINT), re.compile(LONG_TOKEN)


def redacted_spans(text: Column) -> Column:
    """struct<text, count>: each merged place of secret_spans replaced by a mark of its label; (null, 0) for null."""

    @F.pandas_udf("text string, count int")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = secret_spans(t) if isinstance(t, str) else []
            out, last = [], 0
            for s, e, label in spans:
                out += [t[last:s], f"«REDACTED:{label}»"]
                last = e
            rows.append(("".join([*out, t[last:]]) if spans else t, len(spans)))
        return pd.DataFrame(rows, columns=["text", "count"])

    return run(text)


def key_material_masked(text: Column) -> Column:
    return F.regexp_replace(text, PEM, "«KEY»")


def literals_replaced(text: Column, literals: list[tuple[Column, str]]) -> Column:
    """text with the literals (column, token) replaced, in this order; null and empty literals replace nothing."""
    for value, token in literals:
        text = F.when(F.coalesce(value != "", F.lit(False)), F.replace(text, value, F.lit(f"«{token}»"))).otherwise(text)
    return text


def pseudonym(prefix: str, value: Column, salt: str) -> Column:
    """prefix and six hex digits of a salted hash: equal values have equal pseudonyms everywhere."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{prefix}-"), F.upper(F.sha2(F.concat(F.lit(salt + "\0"), value), 256).substr(1, 6))))


def env_sanitised(text: Column) -> Column:
    """Settings text with values replaced by references to their names, except those of harmless names."""

    def one(line: Column) -> Column:
        eq = F.instr(line, "=")
        prefix = F.substring_index(line, "=", 1)
        name = F.regexp_replace(F.trim(prefix), r"^export\s+", "")
        value = F.trim(line.substr(eq + 1, F.char_length(line)))
        valid = (eq > 1) & F.regexp_like(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")) & ~F.regexp_like(line, F.lit(r"^\s*(#|$)"))
        safe = ~F.regexp_like(name, F.lit(SENSITIVE_NAME)) & F.regexp_like(name, F.lit(SAFE_NAME)) & (F.char_length(value) <= 256) & ~F.regexp_like(value, F.lit(KEY_BLOCK))
        return F.when(valid & ~safe, F.concat(prefix, F.lit("=${"), name, F.lit("}"))).otherwise(line)

    return F.array_join(F.transform(F.split(text, r"\r?\n", -1), one), "\n")


def chunks(text: Column, size: int = 6000) -> Column:
    """A text in chunks of at most size characters that end at lines; a longer line is a chunk of its own. Empty texts have none."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, line: Column) -> Column:
        full = (F.char_length(acc["now"]) + F.char_length(line) + 1 > size) & (F.char_length(acc["now"]) > 0)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full, F.lit("")).otherwise(acc["now"])
        return F.struct(done.alias("done"), F.concat(now, F.when(now != "", "\n").otherwise(""), line).alias("now"))

    end = lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
    return F.when(text == "", F.array().cast("array<string>")).when(F.char_length(text) <= size, F.array(text)).otherwise(F.aggregate(F.split(text, r"\r?\n", -1), start, add, end))


def thoughts_stripped(text: Column) -> Column:
    """struct<text, error>: a model's answer without the blocks of reasoning before it; EMPTY where nothing is left, MALFORMED where a block isn't closed."""
    out = F.regexp_replace(text, r"(?i)\A(?:\s*<think>(?:(?!</think>)[\s\S])*</think>)+\s*", "")
    return F.struct(out.alias("text"), F.when(out.rlike(r"(?i)\A\s*<think>"), "MALFORMED").when(F.trim(out) == "", "EMPTY").alias("error"))


def shape_counts(text: Column) -> Column:
    """struct with the number of matches of each shape, counted for each alone."""
    return F.struct(*(F.regexp_count(text, F.lit(java(p))).cast("long").alias(k.replace("-", "_")) for k, p, _ in SHAPES))


def deidentified(text: Column) -> Column:
    """Prose in which each value of a shape has a token of its kind, numbered by first appearance within the text."""
    compiled = [(re.compile(java(p)), t) for _, p, t in SHAPES]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return t
            for rx, token in compiled:
                seen: dict[str, str] = {}
                t = rx.sub(lambda m: seen.setdefault(m.group(), f"{token}-{len(seen) + 1:03d}"), t)
            return t

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


OPERATIONAL = ("id", "record_id", "seq", "object_id", "type", "tool", "status", "order_id", "ticket_id")
PERSONAL = ("name", "full_name", "email", "phone", "address", "birthday", "note", "user")


def json_deidentified(text: Column) -> Column:
    """JSON in which values of the shapes have tokens everywhere, and personal fields of objects that also have an operational field have one; null for text that is no JSON. The order of fields stays."""
    compiled = [(re.compile(java(p)), t) for _, p, t in SHAPES]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            seen: dict[tuple[str, str], str] = {}

            def token(kind, v):
                return seen.setdefault((kind, v), f"{kind}-{sum(k == kind for k, _ in seen) + 1:03d}")

            def walk(v):
                if isinstance(v, str):
                    for rx, kind in compiled:
                        v = rx.sub(lambda m: token(kind, m.group()), v)  # noqa: B023
                    return v
                if isinstance(v, list):
                    return [walk(x) for x in v]
                if isinstance(v, dict):
                    names = {re.sub(r"[-_ ]", "_", k.lower()) for k in v}
                    keyed = names & set(OPERATIONAL) and names & set(PERSONAL)
                    return {k: token("FIELD", x) if keyed and isinstance(x, str) and re.sub(r"[-_ ]", "_", k.lower()) in PERSONAL else walk(x) for k, x in v.items()}
                return v

            try:
                return json.dumps(walk(json.loads(t)), ensure_ascii=False)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


def content_route(text: Column) -> Column:
    """How a text is to be de-identified: json, table, configuration, command-output, code or prose."""
    ls = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    n = F.size(ls)
    share = lambda p: F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(p)))) / F.greatest(n, F.lit(1))
    widths = F.transform(F.slice(ls, 1, 5), lambda x: F.size(F.split(x, ",", -1)))
    return (
        F.when(F.try_parse_json(text).isNotNull() & F.trim(text).rlike(r"^[\[{]"), "json")
        .when((n >= 2) & (F.array_min(widths) == F.array_max(widths)) & (F.array_min(widths) > 1), "table")
        .when(share(r"^\s*[A-Za-z_][A-Za-z0-9_.-]*\s*[=:]\s*\S") > 0.6, "configuration")
        .when(share(r"^\s*([$>]|\S+:[0-9]+:|✓|[0-9]{4}-[0-9]{2}-[0-9]{2}T)") > 0.6, "command-output")
        .when(share(r"[{};]\s*$|^\s*(def|class|import|from|return|if|for|func|const|let|var)\b") > 0.5, "code")
        .otherwise("prose")
    )


def path_pseudonym(path: Column) -> Column:
    """A path whose tokens that look like ids (five digits or more, or letters with three digits) have pseudonyms; separators and the rest stay."""

    def one(part: Column) -> Column:
        digits = F.regexp_count(part, F.lit("[0-9]"))
        date = F.regexp_like(part, F.lit("^(19|20)[0-9]{2}(0[1-9]|1[0-2])([0-2][0-9]|3[01])$"))
        personal = F.contains(part, F.lit("@")) | F.regexp_like(part, F.lit("^[0-9]{5,}$")) & ~date | F.regexp_like(part, F.lit("[A-Za-z]")) & (digits >= 3)
        return F.when(personal, F.concat(F.lit("ID-"), F.sha2(part, 256).substr(1, 8))).otherwise(part)

    return F.array_join(F.transform(F.split(path, r"(?<=[/_. -])|(?=[/_. -])", -1), one), "")
