"""Declared schemas. Nothing is inferred; every table is matched against these by name and type."""

from __future__ import annotations

from pyspark.sql import types as T


# Schemas are built in Python only, so importing this module needs no running session.
_NESTED = {
    "array<long>": T.ArrayType(T.LongType()),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,array<long>>": T.MapType(T.StringType(), T.ArrayType(T.LongType())),
}


def _schema(text: str) -> T.StructType:
    """Schema from "name type, name type", types by their JSON names."""
    schema = T.StructType()
    for item in text.split(", "):
        name, kind = item.split(" ", 1)
        schema.add(name, _NESTED.get(kind, kind))
    return schema


# Microdata written by the generator.
INDIVIDUALS = _schema(
    "person_id long, municipality string, province string, region string, birth_year short, "
    "birth_year_upper_bound short, sex string, data_kind string, citizenship_code string")
PERSONS = _schema(
    "person_id long, household_id long, municipality string, province string, region string, "
    "birth_year short, birth_year_upper_bound short, sex string, reference_adult boolean, "
    "data_kind string, citizenship_code string")
HOUSEHOLDS = _schema(
    "household_id long, municipality string, province string, region string, size short, "
    "data_kind string")

# Input documents, one row per municipality.
NATIONAL_INPUT = _schema(
    "code string, province string, region string, male array<long>, female array<long>, "
    "households array<long>")
CITIZENSHIP_INPUT = _schema(
    "code string, foreign_male array<long>, foreign_female array<long>, "
    "countries map<string,array<long>>")

# Territorial bundle.
TERRITORIES = _schema(
    "key string, scheme string, code string, name string, level string, valid_from date, "
    "valid_to date, snapshot date, parent_key string")
SERIES = _schema("code string, title string, unit string, dimensions map<string,string>")
OBSERVATIONS = _schema(
    "territory_key string, series_code string, period date, value decimal(20,6), status string, "
    "upstream_status string, upstream_note string, upstream_unit string, "
    "upstream_unit_multiplier string")
COVERAGE = _schema(
    "series_code string, period date, snapshot date, scheme string, territory_keys array<string>")
CELL = _schema("territory_key string, series_code string, period date")
EQUATIONS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("total", CELL),
    T.StructField("parts", T.ArrayType(CELL)), T.StructField("dimension", T.StringType()),
    T.StructField("tolerance", T.DecimalType(20, 6))])
CHANGES = _schema(
    "event_id string, kind string, effective_date date, source_url string, "
    "evidence_sha256 string, description string, from_keys array<string>, to_keys array<string>, "
    "weight_basis string")
EVIDENCE = _schema("name string, path string, sha256 string, url string, retrieved_at string")

# Columns of the public release tables (identifiers of releases are content hashes
# in the shape of a UUID; geometry, reports and dimension maps are JSON text).
_RELEASE = (
    "id string, dataset_id string, title string, limitations string, source_id string, "
    "is_demo boolean, reference_period date, retrieved_at timestamp, published_at timestamp, "
    "upstream_url string, raw_sha256 string, transform_version string, contract_sha256 string, "
    "license_url string, row_count long")
_OBSERVATION = (
    "release_id string, series_code string, unit string, territory_id long, "
    "territory_code string, territory_name string, scheme string, period date, "
    "value decimal(20,6), status string")
_QUALITY = "release_id string, check_name string, passed boolean, details string"
PUBLIC = {
    name: _schema(text)
    for name, text in {
        "artifacts_v2": "release_id string, kind string, sha256 string, byte_size long",
        "boundaries_v2": "release_id string, territory_id long, geometry string, "
                         "simplification_degrees double",
        "coverage_v2": "release_id string, series_code string, title string, unit string, "
                       "dimensions string, period date, scheme string, territory_snapshot date, "
                       "row_count long",
        "crosswalks_v2": "id long, release_id string, event_id string, kind string, "
                         "effective_date date, source_url string, evidence_sha256 string, "
                         "description string, from_code string, from_scheme string, "
                         "to_code string, to_scheme string, allocation_weight decimal(20,12), "
                         "weight_basis string",
        "observations": _OBSERVATION,
        "observations_v2": _OBSERVATION + ", level string, parent_code string, "
                           "upstream_status string, upstream_note string, upstream_unit string, "
                           "upstream_unit_multiplier string",
        "population_cells": "snapshot_id long, municipality_code integer, sex string, age short, "
                            "citizenship_code short, persons long, region_code short, "
                            "province_code short",
        "population_households": "snapshot_id long, household_id long, municipality_code integer, "
                                 "size short, data_kind string",
        "population_municipalities": "snapshot_id long, code integer, name string, "
                                     "province_code short, province_name string, "
                                     "region_code short, region_name string, persons long, "
                                     "households long, geometry string, longitude double, "
                                     "latitude double",
        "population_persons": "snapshot_id long, person_id long, household_id long, "
                              "municipality_code integer, sex string, birth_year short, "
                              "birth_year_upper_bound short, citizenship_code short, "
                              "reference_adult boolean, reference_date date, age integer, "
                              "age_is_lower_bound boolean, data_kind string",
        "population_provinces": "snapshot_id long, code short, region_code short, "
                                "name string, source_sha256 string, geometry string",
        "population_regions": "snapshot_id long, code short, name string, geometry string",
        "population_snapshots": "id long, run_id string, manifest_sha256 string, "
                                "reference_date date, household_reference date, persons long, "
                                "households long, municipalities integer, is_fixture boolean, "
                                "published_at timestamp, data_kind string, "
                                "located_persons long, report string, provenance string, "
                                "publication_checks string",
        "population_validation": "snapshot_id long, municipality_code integer, kind string, "
                                 "sex string, category short, expected long, actual long",
        "quality": _QUALITY,
        "quality_v2": _QUALITY,
        "releases": _RELEASE,
        "releases_v2": _RELEASE + ", metadata_sha256 string, upstream_last_update timestamp, "
                       "upstream_published_at timestamp, supersedes_release_id string, "
                       "revision_reason string, territory_snapshot date, series_code string, "
                       "attribution string",
        "sources": "id string, name string, homepage string, license_url string, is_demo boolean",
        "territories_v2": "release_id string, territory_id long, scheme string, code string, "
                          "name string, level string, valid_from date, valid_to date, "
                          "parent_code string, snapshot date, has_boundary boolean",
        "text_order": "value string, ordinal long",
    }.items()
}
