"""Quality gates: named checks with a violation count.

Row predicates and group checks are aggregates, so a stage of gates costs few scans and only one
small row per gate reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    violations: int


class QualityError(ValueError):
    """Carries the full report, including the gates that passed."""

    def __init__(self, checks: Sequence[Check]):
        self.checks = list(checks)
        failed = [f"{c.name} ({c.violations})" for c in self.checks if not c.passed]
        super().__init__("Failed gates: " + ", ".join(failed))


@dataclass
class Gates:
    """Collects lazily evaluated gates as (check_name, violations) rows of one DataFrame."""

    frames: list[DataFrame] = field(default_factory=list)

    def rows(self, df: DataFrame, **violations: Column) -> Gates:
        """Row predicates that describe a violation; all of them in a single scan."""
        if violations:
            pairs = [
                F.struct(F.lit(name).alias("check_name"),
                         F.count_if(F.coalesce(bad, F.lit(True))).alias("violations"))
                for name, bad in violations.items()
            ]
            self.frames.append(df.agg(F.array(*pairs).alias("g")).selectExpr("inline(g)"))
        return self

    def counted(self, df: DataFrame, *names: str) -> Gates:
        """Violations that were counted before, in columns with the names of their checks."""
        pairs = [F.struct(F.lit(name).alias("check_name"), F.coalesce(F.sum(name), F.lit(0)).cast(
            "long").alias("violations")) for name in names]
        self.frames.append(df.agg(F.array(*pairs).alias("g")).selectExpr("inline(g)"))
        return self

    def sums(self, name: str, df: DataFrame, column: str) -> Gates:
        """Passes when the sum of a column of counts is zero."""
        return self.counted(df.select(F.col(column).alias(name)), name)

    def empty(self, name: str, df: DataFrame) -> Gates:
        """Passes when the frame of violating rows is empty."""
        self.frames.append(df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"))
        return self

    def unique(self, name: str, df: DataFrame, keys: Sequence[str]) -> Gates:
        return self.empty(name, duplicates(df, keys))

    def aggregate(self, name: str, df: DataFrame, passes: Column) -> Gates:
        """Passes when an aggregate over the frame is true (NULL fails)."""
        bad = F.when(F.coalesce(passes, F.lit(False)), F.lit(0)).otherwise(F.lit(1)).cast("long")
        self.frames.append(df.agg(bad.alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"))
        return self

    def schema(self, name: str, df: DataFrame, expected: T.StructType) -> Gates:
        bad = 0 if schema_matches(df, expected) else 1
        spark = df.sparkSession
        self.frames.append(spark.range(1).select(
            F.lit(name).alias("check_name"), F.lit(bad).cast("long").alias("violations")))
        return self

    def frame(self) -> DataFrame:
        """(check_name, passed, violations), one row per gate."""
        union = reduce(DataFrame.unionByName, self.frames)
        return union.select("check_name", (F.col("violations") == 0).alias("passed"), "violations")

    def evaluate(self) -> list[Check]:
        return [Check(r.check_name, r.passed, r.violations) for r in self.frame().collect()]

    def require(self) -> list[Check]:
        """All checks, or a QualityError that holds all of them."""
        checks = self.evaluate()
        if not all(c.passed for c in checks):
            raise QualityError(checks)
        return checks


def schema_matches(df: DataFrame, expected: T.StructType) -> bool:
    """Same names and types in the same order; nullability is not part of a stored schema."""
    found = [(f.name, f.dataType) for f in df.schema.fields]
    return found == [(f.name, f.dataType) for f in expected.fields]


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def outside_domain(domains: dict[str, Sequence[object]]) -> dict[str, Column]:
    """Violation predicate per column: the value is NULL or not one of the allowed values."""
    return {name: F.col(name).isNull() | ~F.col(name).isin(list(values))
            for name, values in domains.items()}


def domain_report(df: DataFrame, domains: dict[str, Sequence[object]]) -> DataFrame:
    return Gates().rows(df, **outside_domain(domains)).frame()


def not_digits(column: Column) -> Column:
    """Violation predicate: not a plain nonnegative integer (anchored, no trailing newline)."""
    return ~F.coalesce(column.rlike(r"\A[0-9]+\z"), F.lit(False))


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        a.withColumn("in_left", F.lit(True))
        .join(b.withColumn("in_right", F.lit(True)), list(keys), "full")
        .filter(F.col("in_left").isNull() | F.col("in_right").isNull())
        .select(*keys, F.when(F.col("in_left"), "left").otherwise("right").alias("side"))
    )


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent."""
    referenced = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(on.values())])
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    match = reduce(lambda a, b: a & b,
                   [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(on)])
    return child.filter(filled).join(referenced, match, "left_anti")


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()
