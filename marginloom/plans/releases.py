"""Releases: identities, revisions, observation loads and the catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.functions.hashing import content_id, row_digest
from marginloom.operators import gates
from marginloom.operators.intervals import overlapping
from marginloom.operators.ordering import with_ordinal
from marginloom.plans.coverage import CELL
from marginloom.plans.publish import conform

PERIOD_KEYS = ["dataset_id", "reference_period"]


def release_id(*digests: F.Column) -> F.Column:
    """The same dataset, inputs, contract and rules always give the same id."""
    return content_id(*digests)


def latest_releases(releases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest release per dataset and period; the larger id wins a tie."""
    keys = keys or PERIOD_KEYS
    return releases.groupBy(*keys).agg(
        F.max_by(F.struct(*releases.columns), F.struct("published_at", "id")).alias("_r")
    ).select("_r.*")


def supersession(releases: DataFrame) -> DataFrame:
    """Each release with its successor, if any; superseded releases stay readable."""
    later = releases.filter("supersedes_release_id is not null").select(
        F.col("supersedes_release_id").alias("id"), F.col("id").alias("superseded_by"))
    return releases.join(later, "id", "left").select(
        "id", *PERIOD_KEYS, "published_at", "supersedes_release_id", "superseded_by",
        F.col("superseded_by").isNull().alias("is_current"))


def revision_conflicts(new: DataFrame, releases: DataFrame) -> DataFrame:
    """New releases that do not name the current predecessor, or lack (or invent) a reason."""
    current = latest_releases(releases).select(*PERIOD_KEYS, F.col("id").alias("current_id"))
    named, reason = F.col("supersedes_release_id"), F.col("revision_reason")
    blank = F.coalesce(F.trim(reason) == "", F.lit(True))
    bad = (
        ~named.eqNullSafe(F.col("current_id")) | (named.isNotNull() & blank)
        | (named.isNull() & reason.isNotNull()))
    return new.join(current, PERIOD_KEYS, "left").filter(bad)


def unpublished(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose identity is not stored yet: publishing twice adds nothing."""
    return new.join(existing.select(*keys), keys, "left_anti")


def identity_conflicts(new: DataFrame, existing: DataFrame, identity: str,
                       digest: str) -> DataFrame:
    """A known identity with another content digest."""
    known = existing.select(identity, F.col(digest).alias("_known"))
    return new.join(known, identity).filter(~F.col(digest).eqNullSafe(F.col("_known")))


def release_diff(before: DataFrame, after: DataFrame, keys: list[str],
                 value: str = "value") -> DataFrame:
    """Cells whose value differs between a release and its predecessor, NULL-safe."""
    left = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_l"))
    right = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_r"))
    changed = ~F.col("before").eqNullSafe(F.col("after")) | F.col("_l").isNull() | F.col(
        "_r").isNull()
    return left.join(right, keys, "full").filter(changed).drop("_l", "_r")


def definition_changes(new: DataFrame, existing: DataFrame, keys: list[str],
                       attributes: list[str]) -> DataFrame:
    """Distinct changes of known identities whose immutable attributes differ (series, territories)."""
    old = existing.select(*keys, F.struct(*attributes).alias("_old")).distinct()
    return new.select(*keys, F.struct(*attributes).alias("_new")).distinct().join(old, keys).filter(
        ~F.col("_old").eqNullSafe(F.col("_new")))


def overlapping_versions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Versions of the same code that start on another day but overlap a stored one.

    A version without an end is open. A code with many versions is spread over days, so work grows
    with the versions and the overlaps found, not with all pairs of a code.
    """
    old = existing.select("scheme", "code", F.col("valid_from").alias("old_from"),
                          F.col("valid_to").alias("old_to")).distinct()
    return overlapping(new, old, ["scheme", "code"], ("valid_from", "valid_to"), ("old_from", "old_to"))


def assign_territory_ids(territories: DataFrame, existing: DataFrame) -> DataFrame:
    """Reuse the stored id of a version, otherwise take the next ones in (scheme, code) order."""
    keys = ["scheme", "code", "valid_from"]
    known = existing.select(*keys, "territory_id").distinct()
    joined = territories.join(known, keys, "left")
    old = joined.filter("territory_id is not null")
    fresh = joined.filter("territory_id is null").drop("territory_id")
    top = existing.agg(F.coalesce(F.max("territory_id"), F.lit(0))).scalar()
    new = with_ordinal(fresh, keys, "_place").withColumn(
        "territory_id", (F.col("_place") + top).cast("long"))
    return old.select(*territories.columns, "territory_id").unionByName(
        new.select(*territories.columns, "territory_id"))


def load_observations(observations: DataFrame, territories: DataFrame, series: DataFrame,
                      release: str) -> DataFrame:
    """Observations with territory id, code, name, level, parent code and unit."""
    parent = territories.select(F.col("key").alias("parent_key"), F.col("code").alias("parent_code"))
    place = territories.select(
        F.col("key").alias("territory_key"), "territory_id", F.col("code").alias("territory_code"),
        F.col("name").alias("territory_name"), "scheme", "level", "parent_key").join(
        parent, "parent_key", "left")
    units = series.select(F.col("code").alias("series_code"), "unit")
    return conform(observations.join(place, "territory_key").join(units, "series_code").withColumn(
        "release_id", F.lit(release)), "observations_v2")


def load_mismatches(staged: DataFrame, territories: DataFrame, loaded: DataFrame,
                    release: str) -> DataFrame:
    """Validated observations that are missing from the loaded table or differ in it."""
    ids = territories.select(F.col("key").alias("territory_key"), "territory_id")
    content = ["value", "status", "upstream_status", "upstream_note", "upstream_unit",
               "upstream_unit_multiplier"]
    keys = ["series_code", "territory_id", "period"]
    left = staged.join(ids, "territory_key").select(*keys, F.struct(*content).alias("_staged"))
    right = loaded.filter(F.col("release_id") == release).select(
        *keys, F.struct(*content).alias("_loaded"))
    return left.join(right, keys, "left").filter(
        ~F.col("_staged").eqNullSafe(F.col("_loaded")))


def coverage_table(rows: DataFrame, series: DataFrame, release: str) -> DataFrame:
    """Coverage with its series definition; dimensions become JSON with sorted keys."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("dimensions"))))
    kind = series.select(F.col("code").alias("series_code"), "title", "unit",
                         ordered.alias("dimensions"))
    return conform(rows.join(kind, "series_code").withColumn(
        "release_id", F.lit(release)).withColumnRenamed("snapshot", "territory_snapshot"),
        "coverage_v2")


def quality_rows(checks: DataFrame, release: str, details: str = "{}") -> DataFrame:
    return conform(checks.withColumn("release_id", F.lit(release)).withColumn(
        "details", F.lit(details)), "quality_v2")


def artifact_rows(inventory: DataFrame, release: str) -> DataFrame:
    """inventory(kind, sha256, bytes) as artifact rows."""
    return conform(inventory.withColumnRenamed("bytes", "byte_size").withColumn(
        "release_id", F.lit(release)), "artifacts_v2")


def manifest_of(df: DataFrame, *keys: str) -> DataFrame:
    """For each key, `rows` and `content`, the sum of 60 bits of each row's hash, which knows no order."""
    bits = F.conv(F.substring(row_digest(*df.columns), 1, 15), 16, 10).cast("long")
    # Both halves are summed as longs; a decimal is made once a group, not once a row.
    high, low = (F.coalesce(F.sum(half), F.lit(0)).cast("decimal(19,0)") for half in (
        F.shiftright("_bits", 30), F.col("_bits").bitwiseAND(F.lit((1 << 30) - 1))))
    content = high * F.lit(1 << 30).cast("decimal(10,0)") + low
    return df.select(*keys, bits.alias("_bits")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), content.cast("string").alias("content"))


def table_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free digest per table."""
    frames = [manifest_of(df).select(F.lit(name).alias("table"), "rows", "content") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)


def manifest_mismatches(stored: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    actual = table_manifest(tables).withColumnsRenamed({"rows": "found_rows",
                                                        "content": "found_content"})
    return stored.join(actual, "table", "full").filter(
        ~F.col("rows").eqNullSafe(F.col("found_rows"))
        | ~F.col("content").eqNullSafe(F.col("found_content")))


def demo_observations(rows: DataFrame, release: str, scheme: str, series: str = "population",
                      unit: str = "persons") -> DataFrame:
    """Normalised demo rows in the shape of the observation tables, ids in code order."""
    numbered = with_ordinal(rows, ["territory_code", "period"], "territory_id")
    return conform(numbered.select(
        "*", F.lit(release).alias("release_id"), F.lit(series).alias("series_code"),
        F.lit(unit).alias("unit"), F.lit(scheme).alias("scheme"), F.col("population").alias("value"),
        F.lit("demo").alias("status"), F.lit("municipality").alias("level")), "observations_v2")


def regional_observations(rows: DataFrame, release: str, scheme: str, series: str, unit: str,
                          root_code: str = "IT", first_id: int = 1) -> DataFrame:
    """A regional slice (territory_code, territory_name, level, period, population, upstream_*)."""
    numbered = with_ordinal(rows, ["level", "territory_code"], "territory_id", start=first_id)
    parent = F.when(F.col("level") == "region", F.lit(root_code))
    return conform(numbered.select(
        "*", F.lit(release).alias("release_id"), F.lit(series).alias("series_code"),
        F.lit(unit).alias("unit"), F.lit(scheme).alias("scheme"), F.col("population").alias("value"),
        F.lit("unflagged_upstream").alias("status"), parent.alias("parent_code")),
        "observations_v2")


def metadata_fingerprint(codes: DataFrame, components: DataFrame) -> DataFrame:
    """Digest of the meaning of a structure: code and component rows, not their order."""
    return table_manifest({"codes": codes, "components": components}).agg(
        F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(
            ":", "table", F.col("rows").cast("string"), "content")))), 256).alias("fingerprint"))


def observation_cells(observations: DataFrame) -> DataFrame:
    return observations.select(*CELL, "value")


def release_gates(new: DataFrame, releases: DataFrame) -> gates.Gates:
    return gates.Gates().empty("revision_rule", revision_conflicts(new, releases))
