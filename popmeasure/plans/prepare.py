"""Classification and lookups that the admissions and deaths plans share.

Each lookup is optional. Pass only those whose columns the measure needs: a left join that is not asked for is never
planned.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions import (
    age_group,
    before_first,
    classify,
    code_match,
    code_prefix,
    fill_null,
    label_of,
    numbered,
    relabel,
)
from popmeasure.operators.enrich import enrich
from popmeasure.operators.episodes import first_per_key
from popmeasure.operators.reshape import codes_in_row, columns_containing, distinct_causes_in_row
from popmeasure.sources.constants import ICD10_GROUP_RULES, SEX_LABELS

UNDERLYING = "s_underlying_cod_icd10"


def icd_titles(listing: DataFrame, order_by: str, pattern: str | None = None) -> DataFrame:
    """One title per three-character subgroup: the first listed code's.

    The subgroup is the strict three-character prefix, or the first match of `pattern`. Codes without a subgroup end
    in one null group, as in a data frame.
    """
    code = F.col("icd10_code")
    subgroup = code_prefix(code, strict=True) if pattern is None else code_match(code, pattern)
    return first_per_key(listing.withColumn("icd_subgroup", subgroup), "icd_subgroup", order_by).drop(
        "icd10_code", order_by
    )


def add_lookups(
    df: DataFrame,
    lsoa: tuple[DataFrame, str] | None = None,
    ethnicity: DataFrame | None = None,
    unknown_ethnicity: str | None = "Unknown",
    clinical: DataFrame | None = None,
    titles: DataFrame | None = None,
    methods: DataFrame | None = None,
    code: str = "icd_subgroup",
    require_unique: bool = False,
) -> DataFrame:
    """Join the lookups that are given. With `require_unique` a lookup that holds a key twice is an error.

    lsoa       (lookup, column of `df` with the area code): locality, imd_decile, imd_quintile
    ethnicity  ethnicity coding: adds `ethnicity`; `unknown_ethnicity` replaces a missing one unless it is None
    clinical   clinical groups: clinical_group, clinical_subgroup
    titles     subgroup titles from `icd_titles`
    methods    admission methods: admission_group and the nullable flag `emergency`
    """
    if lsoa is not None:
        lookup, column = lsoa
        df = enrich(df, lookup, {column: "lsoa"}, require_unique=require_unique)
    if ethnicity is not None:
        coding = ethnicity.withColumnRenamed("national_code_definition", "ethnicity")
        df = enrich(df, coding, {"ethnic_code": "national_code"}, require_unique=require_unique)
        if unknown_ethnicity is not None:
            df = df.withColumn("ethnicity", fill_null("ethnicity", unknown_ethnicity))
    if clinical is not None:
        groups = clinical.select("code", "clinical_group", "clinical_subgroup")
        df = enrich(df, groups, {code: "code"}, require_unique=require_unique)
    if titles is not None:
        df = enrich(df, titles, {code: "icd_subgroup"}, require_unique=require_unique)
    if methods is not None:
        df = enrich(df, methods, "admission_method_description", require_unique=require_unique)
        df = df.withColumn("emergency", F.col("admission_group") == "Emergency")
    return df


def prepare_admissions(df: DataFrame, area_names: Mapping[str, str] | None = None, **lookups) -> DataFrame:
    """Admissions with icd group, age group and area name, plus the requested lookups."""
    out = df.withColumnRenamed("diagnosis_group", "icd_subgroup").withColumns(
        {"cvd_group": classify("icd_subgroup", ICD10_GROUP_RULES), "age_group": age_group("age_on_admission")}
    )
    if area_names is not None:
        out = out.withColumn("local_authority", relabel("local_authority", area_names))
    return add_lookups(out, **lookups)


def _finish_deaths(df: DataFrame, area_names: Mapping[str, str] | None, lookups: dict) -> DataFrame:
    out = df.withColumns({"age_group": age_group("age"), "sex": relabel("sex", SEX_LABELS)})
    if area_names is not None:
        out = out.withColumn("local_authority", relabel("residence_la_code", area_names))
    return add_lookups(out, **lookups)


PERSON_COLUMNS = ("patient_id", "sex", "age", "lsoa", "residence_la_code", "ethnic_code")


def primary_deaths(
    register: DataFrame,
    area_names: Mapping[str, str] | None = None,
    person: tuple[str, ...] = PERSON_COLUMNS,
    prefix: str = "I",
    **lookups,
) -> DataFrame:
    """One row per death with an underlying cause under `prefix`.

    Equals filtering the long form on the underlying-cause column, without building the long form.
    """
    code = F.col(UNDERLYING)
    rows = register.filter(F.startswith(code, F.lit(prefix)) & (F.length(code) >= 3)).select(
        *person,
        code_prefix(code, strict=True).alias("icd_subgroup"),
        classify(code, ICD10_GROUP_RULES).alias("cvd_group"),
    )
    return _finish_deaths(rows, area_names, lookups)


def all_cause_deaths(
    register: DataFrame,
    area_names: Mapping[str, str] | None = None,
    person: tuple[str, ...] | None = None,
    prefix: str = "I",
    causes: str = "_cod_",
    one_record_per_person: bool = False,
    record: str | None = None,
    person_id: str = "patient_id",
    **lookups,
) -> DataFrame:
    """One row per person and distinct three-character cause under `prefix`.

    Rows that agree in every column of `person` are one person; by default these are all columns of the register that
    hold no cause. With `record`, the name of a record id, deaths without a `person_id` are told apart by it and never
    merged; it is no part of the identity otherwise. Repeated codes of a record are removed within its row, the rest by
    one distinct before the lookups. The lookups must hold each key once, else the result would not equal
    de-duplication after them: a lookup with a repeated key is an error.

    With `one_record_per_person` every record is a person of its own and nothing is shuffled.
    """
    cause_columns = columns_containing(register, causes)
    if person is None:
        person = tuple(c for c in register.columns if c not in cause_columns and c != record)
    if one_record_per_person:
        rows = distinct_causes_in_row(register.select(*person, *cause_columns), cause_columns, prefix)
        return _finish_deaths(rows, area_names, lookups)
    rules, labels = numbered(ICD10_GROUP_RULES)
    unlinked = F.lit(None) if record is None else F.when(F.col(person_id).isNull(), F.col(record))
    long = register.select(*person, unlinked.alias("__unlinked"), F.explode(codes_in_row(cause_columns, prefix)).alias("icd10_code"))
    coded = long.filter(F.col("icd10_code").isNotNull()).select(
        *person,
        "__unlinked",
        code_prefix("icd10_code", strict=True).alias("icd_subgroup"),
        classify("icd10_code", rules).alias("cvd_group"),
    )
    rows = coded.distinct().drop("__unlinked").withColumn("cvd_group", label_of("cvd_group", labels))
    return _finish_deaths(rows, area_names, {**lookups, "require_unique": True})


def add_broad_ethnicity(df: DataFrame) -> DataFrame:
    return df.withColumn("ethnicity_broad", before_first("ethnicity", "-"))
