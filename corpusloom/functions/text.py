"""Columns that normalise, strip and measure text; all but NFC stay inside the JVM."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and patterns that decide what a cleaned text is.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URL = rf"(?iu)https?://[^{WS}]+|www\.[^{WS}]+"
TAG = "<[^>]+>"
MANY_SPACES = r"[ \t]{2,}"
REPEATED = r"([^\n])\1{4,}"
LATIN_LETTERS = "A-Za-z"
OUTER_SPACE = rf"\A[{WS}]+|[{WS}]+\z"


@dataclass(frozen=True)
class ScriptProfile:
    """The script that texts shall be in (a character class), and the characters that are kept besides."""

    target: str = r"\x{0900}-\x{097F}"
    besides: str = r"\x{20}-\x{7E}\x{A0}-\x{FF}\x{2000}-\x{206F}\n\r\t"

    @property
    def noise(self) -> str:
        return f"[^{self.target}{self.besides}]"


DEVANAGARI = ScriptProfile()
LATIN = ScriptProfile(target=r"A-Za-z\x{C0}-\x{FF}")


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """NFC; there is no built-in for it.  Texts already in NFC are passed through."""
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, OUTER_SPACE, "")


def without_markup(c: Column) -> Column:
    """URLs and then tags, each replaced by a space; the order matters."""
    return F.regexp_replace(F.regexp_replace(c, URL, " "), TAG, " ")


def without_noise(c: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    """URLs, tags and characters outside the profile become spaces, runs of spaces one, and the ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(without_markup(c), profile.noise, " "), MANY_SPACES, " "))


def cleaned(c: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    return without_noise(normalized(c), profile)


def with_barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however many later predicates use them.

    A filter pushed below a projection would evaluate the expressions again for
    each predicate; a generator stops it.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")
    return df.select("*", made).select(*(c for c in df.columns if c not in columns), *(F.col(f"_made.{n}").alias(n) for n in columns))


def count_of(c: Column, characters: str) -> Column:
    """Code points of a class: what is left without the others, which go in runs (one match a run, not one a character)."""
    return F.length(F.regexp_replace(c, f"[^{characters}]++", ""))


def target_count(c: Column, profile: ScriptProfile = DEVANAGARI) -> Column:
    return count_of(c, profile.target)


def latin_count(c: Column) -> Column:
    return count_of(c, LATIN_LETTERS)


def visible_count(c: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(c, f"[{WS}]++", ""))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its scan has too few partitions for them (small tables, few row groups).

    For what takes far longer to compute than to exchange.  Large tables have
    more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < 2 * cores else df


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def words(c: Column) -> Column:
    """Pieces between white space, none of them empty."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def instruct_prompt(instruction: Column, system: Column | None = None) -> Column:
    """The prompt template; a non-empty system text selects the longer one."""
    plain = F.concat(F.lit("[INST] "), instruction, F.lit(" [/INST]"))
    if system is None:
        return plain
    full = F.concat(F.lit("<|system|> "), system, F.lit(" <|user|> "), instruction, F.lit(" <|assistant|>"))
    return F.when(F.coalesce(system, F.lit("")) != "", full).otherwise(plain)
