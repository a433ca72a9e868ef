"""Quality rules on cleaned text, cheapest first, with the reason of a rejection.

A rule bounds one measure of a text; the first that does not hold is the reason
why the text is rejected.  Rules are data: a corpus with other needs replaces
bounds, leaves rules out or adds some.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """A text is rejected for ``reason`` unless its ``measure`` is at least and at most the bounds given."""

    reason: str
    measure: str
    least: float | None = None
    most: float | None = None

    def broken(self, value: Column) -> Column:
        below = value < self.least if self.least is not None else F.lit(False)
        return below | (value > self.most) if self.most is not None else below


# Reasons, order and bounds of the default rules.
RULES = (
    Rule("too_short", "length", least=20),
    Rule("too_long", "length", most=50_000),
    Rule("few_target_chars", "target", least=10),
    Rule("high_latin_ratio", "latin_ratio", most=0.9),
    Rule("repeated_chars", "repeated", most=0),
)


@dataclass(frozen=True)
class Quality:
    rules: tuple[Rule, ...] = RULES
    profile: T.ScriptProfile = T.DEVANAGARI

    def bounded(self, reason: str, least: float | None = None, most: float | None = None) -> Quality:
        """With other bounds for a rule."""
        return replace(self, rules=tuple(replace(r, least=least, most=most) if r.reason == reason else r for r in self.rules))

    def without(self, *reasons: str) -> Quality:
        return replace(self, rules=tuple(r for r in self.rules if r.reason not in reasons))

    def also(self, *rules: Rule) -> Quality:
        """With rules that are tried after the others."""
        return replace(self, rules=(*self.rules, *rules))


def measures(c: Column, profile: T.ScriptProfile) -> dict[str, Column]:
    """Counts that several rules use, computed once."""
    return {"n_length": F.length(c), "n_target": T.target_count(c, profile), "n_latin": T.latin_count(c), "n_visible": T.visible_count(c)}


def _value(measure: str, c: Column) -> Column:
    n = {k: F.col(f"n_{k}") for k in ("length", "target", "latin", "visible")}
    known = n | {"target_ratio": T.ratio(n["target"], n["visible"]), "latin_ratio": T.ratio(n["latin"], n["visible"]), "repeated": c.rlike(T.REPEATED).cast("int")}
    return known[measure]


def with_reason(df: DataFrame, clean_col: str = "clean", config: Quality = Quality()) -> DataFrame:
    """``df`` with the measures of its cleaned text and ``reject_reason``, null for valid rows."""
    c = F.col(clean_col)
    reason = F.lit(None).cast("string")
    for rule in reversed(config.rules):
        reason = F.when(rule.broken(_value(rule.measure, c)), F.lit(rule.reason)).otherwise(reason)
    return T.with_barrier(df, **measures(c, config.profile)).withColumn("reject_reason", reason)
