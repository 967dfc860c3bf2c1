"""Statistical structure metadata (XML): codelists, dimensions, attributes and dataflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators.gates import Gates, duplicates

# Element and attribute names of the standard structure message; prefixes are kept by the reader.
_NAME = "struct<_VALUE:string,`_xml:lang`:string>"
_REF = "struct<_id:string,_agencyID:string,_version:string>"
_CODE = f"struct<_id:string,`c:Name`:array<{_NAME}>,`s:Parent`:struct<Ref:struct<_id:string>>>"
CODELIST = (
    f"_id string, _agencyID string, _version string, `s:Code` array<{_CODE}>")
_COMPONENT = ("struct<_id:string,_position:string,"
              f"`s:LocalRepresentation`:struct<`s:Enumeration`:struct<Ref:{_REF}>>>")
DATA_STRUCTURE = (
    "_id string, _agencyID string, _version string, "
    "`s:DataStructureComponents` struct<"
    f"`s:DimensionList`:struct<`s:Dimension`:array<{_COMPONENT}>,`s:TimeDimension`:array<{_COMPONENT}>>,"
    f"`s:AttributeList`:struct<`s:Attribute`:array<{_COMPONENT}>>,"
    f"`s:MeasureList`:struct<`s:PrimaryMeasure`:array<{_COMPONENT}>>>")
_ANNOTATION = "struct<_id:string,`c:AnnotationTitle`:string>"
DATAFLOW = (
    "_id string, _agencyID string, _version string, "
    f"`c:Annotations` struct<`c:Annotation`:array<{_ANNOTATION}>>, "
    f"`s:Structure` struct<Ref:{_REF}>")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(
        schema).load(path)


def read_codes(spark: SparkSession, path: str, language: str = "it") -> DataFrame:
    """(codelist, agency, version, code, label, parent), one row per code."""
    lists = _xml(spark, path, "s:Codelist", CODELIST)
    codes = lists.select(
        F.col("_id").alias("codelist"), F.col("_agencyID").alias("agency"),
        F.col("_version").alias("version"), F.explode("s:Code").alias("_c"))
    named = F.filter(F.col("_c").getField("c:Name"),
                     lambda n: n.getField("_xml:lang") == language)
    return codes.select(
        "codelist", "agency", "version", F.col("_c").getField("_id").alias("code"),
        F.coalesce(F.try_element_at(named, F.lit(1)).getField("_VALUE"), F.lit("")).alias("label"),
        F.col("_c").getField("s:Parent").getField("Ref").getField("_id").alias("parent"))


def code_parents(codes: DataFrame, codelist: str) -> DataFrame:
    return codes.filter((F.col("codelist") == codelist) & F.col("parent").isNotNull()).select(
        "code", "parent")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(structure, agency, version, kind, ordinal, id, position, codelist, ...) per component."""
    structures = _xml(spark, path, "s:DataStructure", DATA_STRUCTURE)
    base = [F.col("_id").alias("structure"), F.col("_agencyID").alias("agency"),
            F.col("_version").alias("version")]
    lists = {
        "dimension": ("s:DimensionList", "s:Dimension"),
        "time": ("s:DimensionList", "s:TimeDimension"),
        "attribute": ("s:AttributeList", "s:Attribute"),
        "measure": ("s:MeasureList", "s:PrimaryMeasure"),
    }
    frames = []
    for kind, (group, element) in lists.items():
        items = F.col("s:DataStructureComponents").getField(group).getField(element)
        frames.append(structures.select(*base, F.lit(kind).alias("kind"),
                                        F.posexplode(items).alias("ordinal", "_c")))
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    ref = F.col("_c").getField("s:LocalRepresentation").getField("s:Enumeration").getField("Ref")
    return rows.select(
        "structure", "agency", "version", "kind", "ordinal",
        F.col("_c").getField("_id").alias("id"),
        F.col("_c").getField("_position").alias("position"),
        ref.getField("_id").alias("codelist"), ref.getField("_agencyID").alias("list_agency"),
        ref.getField("_version").alias("list_version"))


def read_dataflows(spark: SparkSession, path: str) -> DataFrame:
    flows = _xml(spark, path, "s:Dataflow", DATAFLOW)
    updates = F.filter(F.col("c:Annotations").getField("c:Annotation"),
                       lambda a: a.getField("_id") == "LAST_UPDATE")
    ref = F.col("s:Structure").getField("Ref")
    return flows.select(
        F.col("_id").alias("dataflow"), F.col("_agencyID").alias("agency"),
        F.col("_version").alias("version"), ref.getField("_id").alias("structure"),
        ref.getField("_agencyID").alias("structure_agency"),
        ref.getField("_version").alias("structure_version"),
        F.when(F.size(updates) == 1, F.element_at(updates, 1).getField("c:AnnotationTitle"))
        .alias("last_update"))


def structure_gates(dataflows: DataFrame, components: DataFrame, codes: DataFrame,
                    expected_flow: dict[str, str], expected_components: DataFrame,
                    reviewed: DataFrame, found: Gates | None = None) -> Gates:
    """Identity of flow and structure, order of components, enumerations and code meanings.

    expected_components(kind, ordinal, id, position, codelist, list_agency, list_version);
    reviewed(codelist, code, label) are meanings that must be present unchanged.
    """
    found = found or Gates()
    identity = F.count_if(F.lit(True))
    for column, value in expected_flow.items():
        identity = identity + F.count_if(~F.col(column).eqNullSafe(F.lit(value)))
    found.aggregate("dataflow_identity", dataflows, identity == 1)
    structure = components.select("structure", "agency", "version").distinct()
    declared = dataflows.select(
        F.col("structure"), F.col("structure_agency").alias("agency"),
        F.col("structure_version").alias("version"))
    found.empty("structure_identity", structure.join(
        declared, ["structure", "agency", "version"], "left_anti"))
    found.aggregate("one_structure", structure, F.count(F.lit(1)) == 1)
    wanted = ["kind", "ordinal", "id", "position", "codelist", "list_agency", "list_version"]
    found.empty("components", components.select(*wanted).exceptAll(
        expected_components.select(*wanted)).unionByName(
        expected_components.select(*wanted).exceptAll(components.select(*wanted))))
    found.empty("unique_codes", duplicates(codes, ["codelist", "code"]))
    lists = codes.select("codelist", F.col("agency").alias("list_agency"),
                         F.col("version").alias("list_version")).distinct()
    found.empty("codelists", components.filter("codelist is not null").join(
        lists, ["codelist", "list_agency", "list_version"], "left_anti"))
    found.empty("reviewed_code_meanings", reviewed.join(
        codes, ["codelist", "code", "label"], "left_anti"))
    return found
