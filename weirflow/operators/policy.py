"""Rules over files: which rule matches by path or by finding, and which decision holds (the most restrictive).

Rules are few and literal: their patterns are compiled into expressions, so files are never joined with rules and nothing is shuffled. Files without a match, and those whose path is null, get the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.scan import glob_regex

#: Actions from the least to the most restrictive; those whose result an external reader sees.
ACTIONS = ("allow", "metadata-only", "summarize-local", "redact", "prepare-locally", "inject", "local-only", "ask", "block")
VISIBLE = ("allow", "redact", "prepare-locally")
DESTINATIONS = {"allow": "external,local", "redact": "external,local", "prepare-locally": "external,local", "metadata-only": "external,local", "summarize-local": "external,local", "local-only": "local"}
ALIASES = {"send": "allow", "send-directly": "allow", "remove-secrets": "redact", "local-ai": "summarize-local", "runtime-only": "inject", "keep-local": "local-only", "exclude": "block"}


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    paths: tuple[str, ...] = ()
    detectors: tuple[str, ...] = ()

    def rank(self) -> int:
        return ACTIONS.index(ALIASES.get(self.action, self.action))


def match(rule: Rule, path: Column, detectors: Column) -> Column:
    """'path', 'detector' or null. Patterns that begin with ! carve exceptions out of the others."""
    yes = [glob_regex(p) for p in rule.paths if not p.startswith("!")]
    no = [glob_regex(p[1:]) for p in rule.paths if p.startswith("!")]
    by_path = F.coalesce(path.rlike("|".join(f"(?:{p})" for p in yes)), F.lit(False)) if yes else F.lit(False)
    if no:
        by_path &= ~F.coalesce(path.rlike("|".join(f"(?:{p})" for p in no)), F.lit(False))
    by_detector = F.coalesce(F.arrays_overlap(detectors, F.array(*(F.lit(d) for d in rule.detectors))), F.lit(False)) if rule.detectors else F.lit(False)
    return F.when(by_path, "path").when(by_detector, "detector")


def decided(files: DataFrame, rules: list[Rule], path: str, detectors: Column, default: str = "allow", interactive: bool = False) -> DataFrame:
    """files with action, rule, via, destinations: of the matching rules the first of the highest rank, if it isn't below the default's. An open question blocks where nobody can answer."""
    each = F.array(*(F.when(match(r, F.col(path), detectors).isNotNull(), F.struct(F.lit(r.rank()).alias("rank"), F.lit(-i).alias("order"), F.lit(r.name).alias("rule"), match(r, F.col(path), detectors).alias("via"))) for i, r in enumerate(rules)))
    low = ACTIONS.index(default)
    x = files.withColumn("_best", F.array_max(F.filter(each, lambda s: s.isNotNull() & (s["rank"] >= low))))
    names = F.array(*(F.lit(a) for a in ACTIONS))
    action = F.coalesce(F.get(names, F.col("_best.rank")), F.lit(default))
    x = x.withColumn("action", action if interactive else F.when(action == "ask", "block").otherwise(action))
    where = F.create_map(*(F.lit(v) for kv in DESTINATIONS.items() for v in kv))
    return x.withColumn("rule", F.coalesce("_best.rule", F.lit("default"))).withColumn("via", F.col("_best.via")).withColumn("destinations", F.coalesce(where[F.col("action")], F.lit(""))).drop("_best")


def by_action(decisions: DataFrame) -> DataFrame:
    """action, files: all actions, also those of no file."""
    zero = decisions.sparkSession.range(1).select(F.explode(F.array(*(F.lit(a) for a in ACTIONS))).alias("action"), F.lit(0).cast("long").alias("files"))
    return zero.unionByName(decisions.groupBy("action").agg(F.count("*").alias("files"))).groupBy("action").agg(F.sum("files").alias("files"))


def within(asked_first: Column, asked_last: Column, first: Column, last: Column) -> Column:
    """Whether an asked range lies within an exposed one."""
    return (asked_first >= first) & (asked_last <= last) & (asked_first <= asked_last)
