"""Filter specs: named text filters that combine with AND into one Column."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.times import bucket_range, dt_bound

Terms = list[tuple[bool, str]]


def parse_terms(text: str | None) -> Terms | None:
    """`a, b, !c` -> [(False, a), (False, b), (True, c)]; None when nothing is left."""
    terms = []
    for part in (text or "").split(","):
        part = part.strip()
        negated = part.startswith("!")
        word = part[1:].strip() if negated else part
        if word:
            terms.append((negated, word))
    return terms or None


def exact_terms(c: Column, terms: Terms) -> Column:
    """Equality tests on the bare column, so they reach the scan's statistics."""
    wanted = [t for n, t in terms if not n]
    refused = [t for n, t in terms if n]
    tests = ([c.isin(wanted)] if wanted else []) + ([~c.isin(refused)] if refused else [])
    return reduce(Column.__and__, tests)


def _any_and_none(terms: Terms, holds) -> Column:
    wanted = [holds(t) for n, t in terms if not n]
    refused = [~holds(t) for n, t in terms if n]
    return reduce(Column.__and__, ([reduce(Column.__or__, wanted)] if wanted else []) + refused)


def substring_terms(c: Column, terms: Terms, lowered: bool = False) -> Column:
    """Any wanted term inside, none of the refused, whatever the case."""
    c = F.coalesce(c, F.lit(""))
    c = c if lowered else F.lower(c)
    return _any_and_none(terms, lambda t: c.contains(F.lower(F.lit(t))))


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from their decompositions."""
    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))[0]) for p in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower() and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accents()


def token_text(c: Column) -> Column:
    """Lower-cased, accent-free tokens, one space before, between and after."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, BASE)
    words = F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def phrase_terms(c: Column, terms: Terms) -> Column:
    """Full-text reading of the terms: contiguous whole tokens.

    (any wanted phrase) and none of the refused ones; with refused terms only,
    they are plain substrings, as a token index cannot answer that.
    """
    if all(n for n, _ in terms):
        return substring_terms(c, terms)
    tokens = token_text(c)

    def holds(t: str) -> Column:
        phrase = token_text(F.lit(t))
        return (F.trim(phrase) != "") & tokens.contains(phrase)
    return _any_and_none(terms, holds)


@dataclass(frozen=True)
class FilterSpec:
    level: str = ""
    code: str = ""
    ip: str = ""
    path: str = ""
    q: str = ""
    tpl: str = ""
    dt: str = ""
    dt_from: str = ""
    dt_to: str = ""
    dt_before: str = ""         # exclusive upper end, used by bucket drill-down
    phrase: bool = False        # read `q` as token phrases instead of substrings
    require_time: bool = False  # an upper bound alone also drops rows without a time

    def to_column(self) -> Column:
        tests: list[Column] = []
        for name in ("level", "code"):
            if terms := parse_terms(getattr(self, name)):
                tests.append(exact_terms(F.col(name), terms))
        for name in ("ip", "path"):
            if terms := parse_terms(getattr(self, name)):
                tests.append(substring_terms(F.col(name), terms))
        if terms := parse_terms(self.q):
            tests.append(phrase_terms(F.col("search"), terms) if self.phrase
                         else substring_terms(F.col("search"), terms, lowered=True))
        if self.tpl:
            tests.append(F.col("template") == F.lit(self.tpl))
        if self.dt.strip():
            tests.append(F.col("ts").contains(self.dt.strip()))
        # Canonical times compare as text in time order; '' (no time) sorts first,
        # so such rows fail a lower bound and pass an upper one.
        stamp = F.col("ts_norm")
        if (low := dt_bound(self.dt_from)) is not None:
            tests.append(stamp >= low)
        if (high := dt_bound(self.dt_to)) is not None:
            tests.append(stamp <= high)
        if (before := dt_bound(self.dt_before)) is not None:
            tests.append(stamp < before)
        if self.require_time:
            tests.append(stamp != "")
        return reduce(Column.__and__, tests) if tests else F.lit(True)

    def with_(self, field: str, value: str) -> FilterSpec:
        """Drill down from a top value; fields without a filter go to free text."""
        known = field in {f.name for f in fields(self)}
        return replace(self, **{field if known else "q": value})

    def with_bucket(self, label: str) -> FilterSpec:
        """Drill down from a histogram bucket to its half-open range."""
        span = bucket_range(label)
        return self if span is None else replace(self, dt_from=span[0], dt_before=span[1], dt_to="")


def apply_filter(rows: DataFrame, spec: FilterSpec) -> DataFrame:
    return rows.filter(spec.to_column())


def count_filtered(rows: DataFrame, spec: FilterSpec) -> DataFrame:
    return apply_filter(rows, spec).agg(F.count("*").alias("n"))


def for_owner(rows: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner; on the stored table this prunes partitions."""
    return rows.filter(F.col("owner") == owner)


# --- presets ---------------------------------------------------------------

class Presets:
    """Saved filters in a JSON-lines table: same name replaces, removal by name."""

    def __init__(self, items: dict[str, FilterSpec] | None = None):
        self.items = dict(items or {})

    def add(self, name: str, spec: FilterSpec) -> Presets:
        return Presets({**self.items, name: spec})

    def remove(self, name: str) -> Presets:
        return Presets({k: v for k, v in self.items.items() if k != name})

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(n, json.dumps(asdict(s))) for n, s in self.items.items()],
            "name string, spec string")

    @staticmethod
    def from_table(table: DataFrame) -> Presets:
        """Specs are hand-made settings, read on the driver like any configuration."""
        return Presets({r["name"]: FilterSpec(**json.loads(r["spec"])) for r in table.toLocalIterator()})


def count_by_preset(rows: DataFrame, presets: Presets) -> DataFrame:
    """(preset, n) for all presets in one pass."""
    names = list(presets.items)
    counts = rows.agg(*[F.count_if(presets.items[n].to_column()).alias(f"_{i}")
                        for i, n in enumerate(names)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("preset"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)])))
