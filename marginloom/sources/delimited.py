"""Contract-checked delimited text: exact title, exact header, exact shape, exact row count."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginloom.operators.gates import Gates

MALFORMED = "_malformed"
BYTE_ORDER_MARK = "\ufeff"


@dataclass(frozen=True)
class Contract:
    """`header` are the published column names, `names` what they are called here."""

    header: Sequence[str]
    names: Sequence[str]
    title: str | None = None
    sep: str = ";"
    rows: int | None = None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse(lines: DataFrame, contract: Contract) -> DataFrame:
    """Data rows as text columns plus `_malformed`, the raw line where the shape is wrong.

    Title and header are recognised by their exact text, so the lines need no order.
    """
    text = _clean(lines)
    preamble = [_header(contract)] + ([contract.title] if contract.title is not None else [])
    data = text.filter(~F.col("value").isin(preamble) & (F.col("value") != ""))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in contract.names]
                          + [T.StructField(MALFORMED, T.StringType())])
    parsed = F.from_csv("value", schema.toDDL(), {
        "sep": contract.sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})
    return data.select(parsed.alias("_r")).select("_r.*")


def shape_gates(lines: DataFrame, contract: Contract, found: Gates | None = None) -> Gates:
    """One title, one header, no malformed row, the expected number of rows."""
    found = found or Gates()
    text = _clean(lines)
    if contract.title is not None:
        found.aggregate("title", text, F.count_if(F.col("value") == contract.title) == 1)
    found.aggregate("header", text, F.count_if(F.col("value") == _header(contract)) == 1)
    rows = parse(lines, contract)
    found.rows(rows, row_shape=F.col(MALFORMED).isNotNull())
    if contract.rows is not None:
        found.aggregate("row_count", rows, F.count(F.lit(1)) == contract.rows)
    return found


def read(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Rows of a file that satisfies its contract; a QualityError otherwise."""
    lines = read_lines(spark, path)
    shape_gates(lines, contract).require()
    return parse(lines, contract).drop(MALFORMED)


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str],
                    sep: str = ",") -> DataFrame:
    """Headed CSV with every column as text; the header must equal `columns`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(MALFORMED, T.StringType())])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, sep=sep,
                          mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)


def profile_gates(rows: DataFrame, domains: dict[str, Sequence[str]], value: str = "OBS_VALUE",
                  expected_rows: int | None = None, found: Gates | None = None) -> Gates:
    """Shape, reviewed domains and digits-only values of a text table, in one scan."""
    from marginloom.operators.gates import not_digits

    found = found or Gates()
    checks = {"counts": not_digits(F.col(value))}
    if MALFORMED in rows.columns:
        checks["row_shape"] = F.col(MALFORMED).isNotNull()
    for column, allowed in domains.items():
        # An empty field is read as NULL; the contract lists it as the empty text.
        checks[f"domain_{column}"] = ~F.coalesce(column, F.lit("")).isin(list(allowed))
    found.rows(rows, **checks)
    if expected_rows is not None:
        found.aggregate("row_count", rows, F.count(F.lit(1)) == expected_rows)
    return found


def _clean(lines: DataFrame) -> DataFrame:
    return lines.select(F.rtrim(F.regexp_replace(
        F.col("value"), "^" + BYTE_ORDER_MARK, "")).alias("value"))


def _header(contract: Contract) -> str:
    return contract.sep.join(contract.header)
