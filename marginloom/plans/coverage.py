"""Territorial bundles: versions, observations, coverage, equations and changes.

Equations and coverage are kept in long form (one row per part or member), so a parent with any
number of children is never gathered into one array. `equations(name, dimension, tolerance,
territory_key, series_code, period)` holds the totals and `parts(name, territory_key, series_code,
period)` the parts; `members(series_code, period, scheme, snapshot, territory_key)` the coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginloom.operators import gates
from marginloom.operators.ordering import with_ordinal
from marginloom.session import materialize, materialize_all

# Fixed values of the bundle rules.
LEVEL_RANK = {"country": 0, "region": 1, "province": 2, "municipality": 3}
NULL_STATUSES = ("missing", "suppressed")
VALUE_LIMIT = 10**14
RANGE_END = 1000
RANGE_START = {"age": 0, "household_size": 1}
PARTITION_LABELS = {"sex": ["F", "M"], "occupancy": ["occupied", "unoccupied"]}
DIMENSIONS = ("sex", "age", "household_size", "occupancy")
CELL = ("territory_key", "series_code", "period")


def rank_of(level: F.Column) -> F.Column:
    pairs = F.create_map(*[F.lit(v) for pair in LEVEL_RANK.items() for v in pair])
    return F.element_at(pairs, level)


def explode_equations(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and parts of equations that arrive as one document row each."""
    headers = nested.select("name", "dimension", "tolerance", "total.*")
    parts = nested.select("name", F.explode("parts").alias("p")).select("name", "p.*")
    return headers, parts


def explode_coverage(nested: DataFrame) -> DataFrame:
    return nested.select("series_code", "period", "scheme", "snapshot",
                         F.explode("territory_keys").alias("territory_key"))


# Territory versions -------------------------------------------------------------------------


def overlapping_intervals(df: DataFrame, keys: list[str], start: str = "valid_from",
                          end: str = "valid_to") -> DataFrame:
    """Versions of one key whose half-open interval reaches into the next one.

    The next start is looked up inside a month first; only the last version of a month looks at the
    first start of the key's next month. So a key with very many versions is spread over its
    months, and no window holds all of them. `start` is a DATE.
    """
    by_month = [*keys, "_month"]
    rows = df.withColumn("_month", F.trunc(start, "month"))
    first = rows.groupBy(*by_month).agg(F.min(start).alias("_first"))
    following = first.select(*by_month, F.lead("_first").over(
        Window.partitionBy(*keys).orderBy("_month")).alias("_later"))
    within = F.lead(start).over(Window.partitionBy(*by_month).orderBy(start, end))
    return (
        rows.repartition(*by_month).withColumn("_within", within)
        .join(following.hint("merge"), by_month, "left")
        .withColumn("next_start", F.coalesce("_within", "_later"))
        .filter(F.col("next_start") < F.col(end))
        .select(*df.columns, "next_start")
    )


def hierarchy_violations(territories: DataFrame) -> DataFrame:
    parent = territories.select(
        F.col("key").alias("parent_key"), F.col("scheme").alias("p_scheme"),
        F.col("snapshot").alias("p_snapshot"), F.col("level").alias("p_level"),
        F.col("valid_from").alias("p_from"), F.col("valid_to").alias("p_to"))
    good = (
        (F.col("p_scheme") == F.col("scheme")) & (F.col("p_snapshot") == F.col("snapshot"))
        & (rank_of(F.col("p_level")) < rank_of(F.col("level")))
        & (F.col("p_from") <= F.col("valid_from")) & (F.col("valid_to") <= F.col("p_to")))
    return territories.filter("parent_key is not null").join(
        parent, "parent_key", "left").filter(~F.coalesce(good, F.lit(False)))


def territory_gates(territories: DataFrame, found: gates.Gates | None = None) -> gates.Gates:
    found = found or gates.Gates()
    found.unique("unique_territories", territories, ["key"])
    valid = (F.col("valid_from") <= F.col("snapshot")) & (F.col("snapshot") < F.col("valid_to"))
    found.rows(
        territories,
        territorial_validity=~(valid & (F.trim("name") != "")),
        territorial_root=F.col("parent_key").isNull() & (F.col("level") != "country"))
    found.empty("hierarchy", hierarchy_violations(territories))
    found.empty("territorial_overlap", overlapping_intervals(territories, ["scheme", "code"]))
    return found


def level_counts_violations(territories: DataFrame, expected: DataFrame) -> DataFrame:
    """Levels whose number of territories is not the reviewed one; expected(level, n)."""
    actual = territories.groupBy("level").agg(F.count(F.lit(1)).alias("found"))
    return expected.join(actual, "level", "full").filter(~F.col("n").eqNullSafe(F.col("found")))


def unexplained_changes(territories: DataFrame, changes: DataFrame,
                        level: str = "municipality") -> DataFrame:
    """Codes that appear or disappear between consecutive snapshots without an event."""
    codes = territories.filter(F.col("level") == level).select("snapshot", "code").distinct()
    days = codes.select("snapshot").distinct()
    # One row a snapshot. Stored, its size is known: codes are not shuffled by a few snapshots.
    pairs = materialize(days.withColumn("next_snapshot", F.lead("snapshot").over(
        Window.partitionBy(F.lit(0)).orderBy("snapshot"))).filter("next_snapshot is not null"), "snapshots")
    old = codes.join(pairs, "snapshot").select(
        F.col("snapshot").alias("before"), F.col("next_snapshot").alias("after"), "code")
    new = codes.withColumnRenamed("snapshot", "next_snapshot").join(
        pairs, "next_snapshot").select(
        F.col("snapshot").alias("before"), F.col("next_snapshot").alias("after"), "code")
    keys = ["before", "after", "code"]
    gone = old.join(new, keys, "left_anti").withColumn("change", F.lit("removed"))
    come = new.join(old, keys, "left_anti").withColumn("change", F.lit("added"))
    place = territories.select(F.col("key"), F.col("code"), F.col("snapshot"))
    first_from = place.select(F.col("key").alias("_f"), F.col("snapshot").alias("before"))
    first_to = place.select(F.col("key").alias("_t"), F.col("snapshot").alias("after"))
    events = (
        changes.select("from_keys", "to_keys", F.element_at("from_keys", 1).alias("_f"),
                       F.element_at("to_keys", 1).alias("_t"))
        .join(first_from, "_f").join(first_to, "_t"))

    def explained(column: str, change: str) -> DataFrame:
        return events.select("before", "after", F.explode(column).alias("key")).join(
            place.select("key", "code"), "key").select(*keys).withColumn("change", F.lit(change))

    known = explained("from_keys", "removed").unionByName(explained("to_keys", "added"))
    return gone.unionByName(come).join(known, [*keys, "change"], "left_anti")


# Observations and coverage ------------------------------------------------------------------


def observation_gates(observations: DataFrame, territories: DataFrame, series: DataFrame,
                      is_demo: bool, found: gates.Gates | None = None) -> gates.Gates:
    found = found or gates.Gates()
    found.unique("unique_series", series, ["code"])
    found.unique("unique_observations", observations, list(CELL))
    value = F.col("value")
    found.rows(
        observations,
        source_status=(F.col("status") == "demo") != F.lit(is_demo),
        null_status=value.isNull() != F.col("status").isin(*NULL_STATUSES),
        numeric_range=value.isNotNull() & ((value < 0) | (value >= VALUE_LIMIT)
                                           | (value != F.floor(value))))
    place = territories.select(F.col("key").alias("territory_key"), "valid_from", "valid_to")
    known = series.select(F.col("code").alias("series_code"), F.lit(True).alias("_s"))
    context = observations.join(place, "territory_key", "left").join(known, "series_code", "left")
    inside = (F.col("valid_from") <= F.col("period")) & (F.col("period") < F.col("valid_to"))
    found.rows(context, observation_context=~F.coalesce(inside & F.col("_s"), F.lit(False)))
    return found


def coverage_members(observations: DataFrame, territories: DataFrame) -> DataFrame:
    """Coverage that the observations themselves imply."""
    place = territories.select(F.col("key").alias("territory_key"), "scheme", "snapshot")
    return observations.join(place, "territory_key").select(
        "series_code", "period", "scheme", "snapshot", "territory_key")


def coverage_rows(members: DataFrame) -> DataFrame:
    return members.groupBy("series_code", "period").agg(
        F.min("scheme").alias("scheme"), F.min("snapshot").alias("snapshot"),
        F.count(F.lit(1)).alias("row_count"))


def coverage_gates(members: DataFrame, observations: DataFrame, territories: DataFrame,
                   default: tuple[str, str] | None = None,
                   found: gates.Gates | None = None) -> gates.Gates:
    found = found or gates.Gates()
    found.unique("coverage_unique", members, list(CELL))
    found.empty("coverage_exact", gates.set_difference(members, observations, list(CELL)))
    vintages = members.groupBy("series_code", "period").agg(
        F.count_distinct(F.struct("scheme", "snapshot")).alias("vintages"))
    found.empty("coverage_single_vintage", vintages.filter("vintages <> 1"))
    place = territories.select(F.col("key").alias("territory_key"), "scheme", "snapshot")
    found.empty("coverage_vintage", members.join(
        place, ["territory_key", "scheme", "snapshot"], "left_anti"))
    if default is not None:
        chosen = (F.col("series_code") == default[0]) & (
            F.col("period") == F.lit(default[1]).cast("date"))
        found.aggregate("default_selection", members, F.count_if(chosen) > 0)
    return found


def cross_source_conflicts(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells that several sources report with different values."""
    return cells.groupBy(*keys).agg(
        F.count_distinct(value).alias("values"), F.count(F.lit(1)).alias("sources")
    ).filter("values > 1")


def merge_sources(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per cell, and the number of cells that were seen more than once.

    Of several rows the smallest by its other columns stays, whatever the order of the sources.
    """
    rest = [c for c in cells.columns if c not in keys]
    seen = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sources"), F.min(F.struct(*rest)).alias("_row"))
    merged = seen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*cells.columns)
    return merged, seen.agg(F.count_if(F.col("_sources") > 1).alias("matched"))


# Equations ----------------------------------------------------------------------------------


def territory_equations(observations: DataFrame,
                        territories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A parent equals the sum of its children wherever two or more of them are observed."""
    link = territories.filter("parent_key is not null").select(
        F.col("key").alias("territory_key"), "parent_key")
    cells = observations.select(*CELL)
    total = cells.withColumnRenamed("territory_key", "parent_key")
    pairs = cells.join(link, "territory_key").join(
        total, ["parent_key", "series_code", "period"]).withColumn(
        "name", F.concat_ws(":", F.lit("geo"), "series_code", "parent_key"))
    return _equations(pairs, "territory", "parent_key", "series_code")


def dimension_equations(observations: DataFrame, territories: DataFrame,
                        series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A TOTAL series equals its siblings that differ in one dimension only."""
    sides = series.select("code", "dimensions", F.explode("dimensions").alias("dimension", "label"))
    rest = F.array_sort(F.map_entries(F.map_filter(
        "dimensions", lambda k, v: k != F.col("dimension"))))
    sides = sides.filter(F.col("dimension").isin(*DIMENSIONS)).select(
        "code", "dimension", "label", F.to_json(rest).alias("_rest"))
    totals = sides.filter("label = 'TOTAL'").select(
        F.col("code").alias("total_code"), "dimension", "_rest")
    pairs = totals.join(
        sides.filter("label <> 'TOTAL'").select(F.col("code").alias("series_code"), "dimension",
                                                "_rest"), ["dimension", "_rest"])
    current = territories.select(F.col("key").alias("territory_key"),
                                 F.col("snapshot").alias("period"))
    cells = observations.select(*CELL).join(current, ["territory_key", "period"], "left_semi")
    total = cells.withColumnRenamed("series_code", "total_code")
    found = (
        cells.join(pairs.drop("_rest"), "series_code")
        .join(total, ["territory_key", "total_code", "period"])
        .withColumn("name", F.concat_ws(":", "dimension", "territory_key", "total_code")))
    return _equations(found, None, "territory_key", "total_code")


def _equations(pairs: DataFrame, dimension: str | None, territory: str,
               series: str) -> tuple[DataFrame, DataFrame]:
    label = F.col("dimension") if dimension is None else F.lit(dimension)
    keyed = pairs.withColumn("_dimension", label)
    headers = keyed.groupBy(
        "name", F.col("_dimension").alias("dimension"), F.col(territory).alias("territory_key"),
        F.col(series).alias("series_code"), "period").agg(F.count(F.lit(1)).alias("parts"))
    headers = headers.filter("parts >= 2").select(
        "name", "dimension", F.lit(0).cast("decimal(20,6)").alias("tolerance"), *CELL)
    parts = keyed.select("name", *CELL).join(headers.select("name", "period"),
                                             ["name", "period"], "left_semi")
    return headers, parts.select("name", *CELL)


def equation_terms(equations: DataFrame, parts: DataFrame, observations: DataFrame,
                   territories: DataFrame, series: DataFrame) -> DataFrame:
    """One row per part with the attributes of its own cell and of the total.

    Store the result before passing it to several checks: each of them is a pass over it.
    """
    place = territories.select(F.col("key").alias("territory_key"), "scheme", "parent_key")
    kind = series.select(F.col("code").alias("series_code"), "unit", "dimensions")
    values = observations.select(*CELL, "value", F.lit(True).alias("found"))

    def described(df: DataFrame) -> DataFrame:
        return df.join(place, "territory_key", "left").join(kind, "series_code", "left").join(
            values, list(CELL), "left")

    wanted = ["territory_key", "series_code", "period", "scheme", "parent_key", "unit",
              "dimensions", "value", "found"]
    left = described(equations).select(
        "name", "dimension", "tolerance", *[F.col(c).alias(f"t_{c}") for c in wanted])
    right = described(parts).select("name", *[F.col(c).alias(f"p_{c}") for c in wanted])
    return left.join(right, "name", "left")


def equation_check(terms: DataFrame) -> DataFrame:
    """Per equation: sum of the parts, total, difference and whether it is within tolerance."""
    summed = terms.groupBy("name").agg(
        F.first("dimension").alias("dimension"),
        F.count("p_territory_key").alias("parts"),
        F.first("t_value").cast("decimal(20,6)").alias("total"),
        F.sum("p_value").cast("decimal(26,6)").alias("parts_sum"),
        F.first("tolerance").alias("tolerance"))
    difference = (F.col("parts_sum") - F.col("total")).cast("decimal(26,6)")
    return summed.withColumn("difference", difference).withColumn(
        "reconciled", F.coalesce(F.abs("difference") <= F.col("tolerance"), F.lit(False)))


def range_tiling(ranges: DataFrame, group: list[str], label: str, start: F.Column,
                 end: int = RANGE_END) -> DataFrame:
    """Groups whose "lo:hi" labels do not tile [start, end) exactly.

    `start` is a column, since the first bound depends on the dimension.
    """
    bounds = F.split(label, ":")
    numeric = F.col(label).rlike(r"\A[0-9]+:[0-9]+\z")
    cut = ranges.select(
        *group, start.alias("_start"), numeric.alias("_ok"),
        F.when(numeric, bounds[0]).try_cast("decimal(38,0)").alias("lo"),
        F.when(numeric, bounds[1]).try_cast("decimal(38,0)").alias("hi"))
    following = F.lead("lo").over(Window.partitionBy(*group).orderBy("lo", "hi"))
    joined = cut.withColumn("_next", following)
    good = F.col("_ok") & (F.col("lo") < F.col("hi")) & (
        F.col("_next").isNull() | (F.col("_next") == F.col("hi")))
    return joined.groupBy(*group).agg(
        F.count_if(~F.coalesce(good, F.lit(False))).alias("breaks"),
        F.min("lo").try_cast("bigint").alias("first"), F.max("hi").try_cast("bigint").alias("last"),
        F.first("_start").alias("required_first")
    ).filter((F.col("breaks") > 0) | ~F.col("first").eqNullSafe(F.col("required_first"))
             | ~F.col("last").eqNullSafe(F.lit(end)))


def equation_gates(equations: DataFrame, parts: DataFrame, terms: DataFrame,
                   found: gates.Gates | None = None) -> gates.Gates:
    found = found or gates.Gates()
    found.unique("equation_names", equations, ["name"])
    found.unique("disjoint_keys", parts, ["name", *CELL])
    found.empty("equation_identity", equations.join(
        parts.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").filter(
        F.coalesce(F.col("n"), F.lit(0)) < 2))
    same = {c: F.col(f"t_{c}").eqNullSafe(F.col(f"p_{c}")) for c in (
        "territory_key", "series_code", "period", "scheme", "unit")}
    by_place = F.col("dimension") == "territory"
    dim = F.col("dimension")

    def others(side: str) -> F.Column:
        entries = F.map_entries(F.map_filter(f"{side}_dimensions", lambda k, v: k != dim))
        return F.to_json(F.array_sort(entries))

    label = F.try_element_at("p_dimensions", dim)
    total_label = F.try_element_at("t_dimensions", dim)
    found.rows(
        terms,
        total_not_a_part=same["territory_key"] & same["series_code"] & same["period"],
        equation_cells=F.col("t_value").isNull() | F.col("p_value").isNull(),
        comparable_units_periods=~(same["unit"] & same["period"] & same["scheme"]),
        disjoint_territories=by_place & ~(same["series_code"] & F.col("p_parent_key").eqNullSafe(
            F.col("t_territory_key"))),
        same_territory=~by_place & ~same["territory_key"],
        partition_total=~by_place & ~total_label.eqNullSafe("TOTAL"),
        partition_dimensions=~by_place & ~others("t").eqNullSafe(others("p")),
        partition_categories=~by_place & (label.isNull() | label.eqNullSafe("TOTAL")),
        equation_tolerance=F.col("tolerance").isNull() | (F.col("tolerance") < 0))
    labelled = terms.filter(~by_place).select("name", "dimension", label.alias("label"))
    found.unique("distinct_labels", labelled, ["name", "label"])
    ranged = labelled.filter(F.col("dimension").isin(*RANGE_START))
    start = F.element_at(F.create_map(*[F.lit(v) for p in RANGE_START.items() for v in p]),
                         F.col("dimension"))
    found.empty("partition_ranges", range_tiling(ranged, ["name"], "label", start))
    for name, labels in PARTITION_LABELS.items():
        # Compared by counts, so an equation with many labels is not gathered into a set.
        chosen = labelled.filter(F.col("dimension") == name).groupBy("name").agg(
            F.count_if(~F.col("label").isin(labels) | F.col("label").isNull()).alias("wrong"),
            F.count_distinct("label").alias("kinds"))
        found.empty(f"partition_labels_{name}", chosen.filter(
            (F.col("wrong") > 0) | (F.col("kinds") != len(labels))))
    found.empty("equation_reconciliation", equation_check(terms).filter("not reconciled"))
    return found


# Changes and exact re-aggregation -----------------------------------------------------------


def change_gates(changes: DataFrame, territories: DataFrame, evidence: DataFrame,
                 found: gates.Gates | None = None) -> gates.Gates:
    found = found or gates.Gates()
    found.unique("event_identity", changes, ["event_id"])
    known = evidence.select(F.col("sha256").alias("evidence_sha256"),
                            F.col("url").alias("source_url")).distinct()
    found.empty("event_evidence",
                changes.join(known, ["evidence_sha256", "source_url"], "left_anti"))
    n_from, n_to = F.size("from_keys"), F.size("to_keys")
    kind = F.col("kind")
    shape = (
        ((kind == "merger") & (n_from > 1) & (n_to == 1))
        | ((kind == "split") & (n_from == 1) & (n_to > 1))
        | (kind.isin("recode", "transfer") & (n_from == 1) & (n_to == 1)))
    found.rows(
        changes,
        event_members=~((n_from > 0) & (n_to > 0)
                        & (F.size(F.array_distinct("from_keys")) == n_from)
                        & (F.size(F.array_distinct("to_keys")) == n_to)),
        event_cardinality=~shape,
        no_invented_weights=~((F.col("weight_basis") == "structural")
                              | kind.isin("merger", "recode")))
    members = changes.select("event_id", "effective_date", F.explode("from_keys").alias("key"),
                             F.lit(True).alias("is_from")).unionByName(
        changes.select("event_id", "effective_date", F.explode("to_keys").alias("key"),
                       F.lit(False).alias("is_from")))
    placed = members.join(territories.select("key", "snapshot", "level"), "key", "left")
    in_time = F.when(F.col("is_from"), F.col("snapshot") < F.col("effective_date")).otherwise(
        F.col("effective_date") <= F.col("snapshot"))
    found.rows(placed, event_known_members=F.col("level").isNull(), event_time=~in_time)
    found.empty("event_level", placed.groupBy("event_id").agg(
        F.count_distinct("level").alias("levels")).filter("levels <> 1"))
    return found


def crosswalk_pairs(changes: DataFrame, territories: DataFrame, first_id: int = 1) -> DataFrame:
    """One row per (event, from, to); weight 1 when exact, NULL when only structural."""
    pairs = changes.withColumn("from_key", F.explode("from_keys")).withColumn(
        "to_key", F.explode("to_keys")).drop("from_keys", "to_keys")

    def side(name: str) -> DataFrame:
        return territories.select(F.col("key").alias(f"{name}_key"),
                                  F.col("code").alias(f"{name}_code"),
                                  F.col("scheme").alias(f"{name}_scheme"))

    weight = F.when(F.col("weight_basis") == "exact", 1).cast("decimal(20,12)")
    rows = pairs.join(side("from"), "from_key").join(side("to"), "to_key").withColumn(
        "allocation_weight", weight)
    return with_ordinal(rows, ["event_id", "from_key", "to_key"], "id", start=first_id)


def reaggregation_gates(values: DataFrame, changes: DataFrame, by: list[str] | None = None) -> gates.Gates:
    """An exact re-aggregation needs complete, disjoint, exact mergers and recodes.

    With `by`, a key has one value for each of these columns; it must have some value.
    """
    found = gates.Gates()
    found.rows(
        changes,
        exact_basis=~((F.col("weight_basis") == "exact") & F.col("kind").isin("merger", "recode")),
        single_target=~((F.size("to_keys") == 1) & (F.size("from_keys") > 0)))
    members = changes.select(F.explode("from_keys").alias("key"))
    found.unique("overlapping_sources", members, ["key"])
    found.unique("overlapping_targets", changes.select(F.explode("to_keys").alias("key")), ["key"])
    found.unique("unique_values", values, ["key", *(by or [])])
    found.empty("same_coverage", gates.set_difference(values, members, ["key"]))
    return found


def reaggregate_exact(values: DataFrame, changes: DataFrame, check: bool = True,
                      by: list[str] | None = None) -> DataFrame:
    """Sum values(key, *by, value) over exact mergers and recodes; anything else is refused."""
    if check:
        reaggregation_gates(values, changes, by).require()
    mapping = changes.select(F.explode("from_keys").alias("key"),
                             F.element_at("to_keys", 1).alias("target"))
    return values.join(mapping, "key").groupBy(F.col("target").alias("key"), *(by or [])).agg(
        F.sum("value").cast("decimal(20,6)").alias("value"))


def bundle_gates(territories: DataFrame, series: DataFrame, observations: DataFrame,
                 members: DataFrame, equations: DataFrame, parts: DataFrame,
                 changes: DataFrame, evidence: DataFrame, is_demo: bool,
                 default: tuple[str, str] | None = None,
                 bounds: dict[str, int] | None = None) -> gates.Gates:
    """Every rule of a bundle in one report.

    `bounds` are the reviewed sizes of this bundle, by observations, territories and coverage (pairs
    of series and period). Without one a table only has to hold something.
    """
    found = gates.Gates()
    bounds = bounds or {}

    def bounded(name: str, df: DataFrame, n: F.Column) -> None:
        limit = bounds.get(name)
        found.aggregate(f"bounded_{name}", df, (n >= 1) if limit is None else n.between(1, limit))

    bounded("observations", observations, F.count(F.lit(1)))
    bounded("territories", territories, F.count(F.lit(1)))
    bounded("coverage", members, F.count_distinct("series_code", "period"))
    territory_gates(territories, found)
    observation_gates(observations, territories, series, is_demo, found)
    coverage_gates(members, observations, territories, default, found)
    stored = materialize_all(equations=equations, parts=parts)
    equations, parts = stored["equations"], stored["parts"]
    terms = materialize(
        equation_terms(equations, parts, observations, territories, series), "terms")
    equation_gates(equations, parts, terms, found)
    found.unique("evidence_identity", evidence, ["name"])
    change_gates(changes, territories, evidence, found)
    return found


def boundary_source_gates(sources: DataFrame, evidence: DataFrame, territories: DataFrame,
                          repairs: DataFrame, reconciliations: DataFrame,
                          is_demo: bool, official_format: str = "shapefile") -> gates.Gates:
    """sources(evidence_name, snapshot, format), repairs(key), reconciliations(passed, method,
    evidence): one source per snapshot, known evidence, known repaired keys, all records passed."""
    found = gates.Gates()
    found.unique("boundary_snapshots", sources, ["snapshot"])
    found.empty("boundary_evidence",
                gates.orphans(sources, evidence, {"evidence_name": "name"}))
    found.empty("boundary_coverage", gates.set_difference(sources, territories, ["snapshot"]))
    if not is_demo:
        found.rows(sources, boundary_format=F.col("format") != official_format)
    found.unique("repairs_unique", repairs, ["key"])
    found.empty("repairs_known", gates.orphans(repairs, territories, {"key": "key"}))
    blank = F.coalesce(F.trim("method") == "", F.lit(True))
    found.rows(reconciliations, reconciliations=~F.coalesce("passed", F.lit(False)) | blank
               | (F.coalesce(F.size("evidence"), F.lit(0)) < 1))
    found.aggregate("reconciliations_present", reconciliations, F.count(F.lit(1)) > 0)
    return found
