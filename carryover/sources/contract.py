"""What each logical table must look like, and how a source is brought there.

A contract lists columns with a type and a role.  ``conform`` renames, trims
type differences once on load and fails on a missing column, before any query
has read a row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One column.  ``role`` is key (an identifier), code (a value list),
    day, or measure; profiles count distinct values of all but measures."""

    name: str
    type: str
    role: str
    required: bool = True


def _fields(text: str) -> tuple[Field, ...]:
    """``name type role`` per line; a trailing ``?`` marks an optional column."""
    out = []
    for line in text.strip().splitlines():
        name, kind, role = line.split()
        out.append(Field(name, kind, role.rstrip("?"), not role.endswith("?")))
    return tuple(out)


CONTRACTS: dict[str, tuple[Field, ...]] = {
    "dx_line": _fields("""
        claim_line_id  id      key
        sequence_id    string  code
        icd9_dx_cd     string  code
        member_id      id      key
        poa_cd         string  code
        load_ts        time    measure?
    """),
    "claim_line": _fields("""
        claim_line_id       id      key
        member_id           id      key
        srv_start_dt        date    day
        pri_icd9_dx_cd      string  code
        plc_srv_cd          string  code
        plc_srv_ctg_cd      string  code
        med_cost_ctg_cd     string  code
        business_ln_cd      string  code
        srv_prvdr_id        id      key
        prcdr_cd            string  code
        allowed_amt         number  measure
        summarized_srv_ind  string  code
        duplicate_ind       string  code
        ntwk_srv_area_id    string  code
        member_county_cd    string  code
    """),
    "code_map": _fields("""
        diagnosis_code  string    code
        hcc_v24         category  code
        hcc_v28         category  code?
    """),
    "member_month": _fields("""
        member_id      id      key
        eff_yr         string  code
        eff_mo         string  code
        age_nbr        whole   code
        gender_cd      string  code
        mbr_county_cd  string  code
        mbr_state      string  code
        mbr_submarket  string  code
        business_ln_cd string  code?
    """),
    "provider": _fields("""
        provider_id        id      key
        epdb_dw_prvdr_id   id      key
        specialty_ctg_cd   string  code
        zip_cd             string  code
        county_nm          string  code
        tin_owner_nm       string  code
    """),
    "curated_claims": _fields("""
        claim_line_id      id      key
        member_id          id      key
        age_nbr            whole   code
        gender_cd          string  code
        mbr_county_cd      string  code?
        mbr_submarket      string  code
        srv_start_dt       date    day
        pri_icd9_dx_cd     string  code
        prcdr_cd           string  code?
        allowed_amt        number  measure?
        business_ln_cd     string  code
        epdb_dw_prvdr_id   id      key
        prvdr_county       string  code?
        prvdr_submarket    string  code
        specialty_ctg_cd   string  code
    """),
    "chronic_ref": _fields("""
        icd_code           string  code
        icd_description    string  measure
        chronic_indicator  string  code
    """),
    "code_version": _fields("""
        diagnosis_code  string    code
        hcc_v24         category  code
        valid_from      date      day
        valid_to        date      day?
    """),
    "member_death": _fields("""
        member_id  id    key
        death_dt   date  day
    """),
    "member_raw": _fields("""
        member_id       id      key
        eff_dt          date    day
        medical_ind     string  code
        business_ln_cd  string  code
        age_nbr         whole   code
        gender_cd       string  code
        mbr_county_cd   string  code
        mbr_state       string  code
        mbr_submarket   string  code
    """),
}

_ACCEPTS: dict[str, tuple[type, ...]] = {
    "id": (T.StringType, T.LongType, T.IntegerType, T.DecimalType),
    "string": (T.StringType, T.VarcharType, T.CharType),
    "whole": (T.LongType, T.IntegerType, T.ShortType),
    "number": (T.DoubleType, T.FloatType, T.DecimalType, T.LongType, T.IntegerType),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "time": (T.TimestampType, T.TimestampNTZType),
    "category": (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.DecimalType),
}


def violations(df: DataFrame, table: str) -> list[str]:
    """Missing columns and types a contract does not accept, as text."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for field in CONTRACTS[table]:
        if field.name not in have:
            if field.required:
                out.append(f"{table}.{field.name}: missing")
        elif not isinstance(have[field.name], _ACCEPTS[field.type]):
            out.append(
                f"{table}.{field.name}: {have[field.name].simpleString()} is not a {field.type}"
            )
    return out


def _fixed(column: Column, field: Field, have: T.DataType) -> Column:
    if field.type == "date":
        return column.cast("date")
    if field.type == "category":
        # A category read as a double prints as '19.0'.
        return F.regexp_replace(column.cast("string"), r"\.0+$", "")
    if field.type == "whole" and not isinstance(have, T.LongType):
        return column.cast("long")
    return column


def conform(df: DataFrame, table: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """The contract's columns of ``df``, renamed and with settled types.

    ``renames`` maps a source name to the logical name.  Raises ``ValueError``
    with every violation at once.
    """
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    wrong = violations(df, table)
    if wrong:
        raise ValueError("; ".join(wrong))
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[
            _fixed(F.col(f.name), f, have[f.name]).alias(f.name)
            for f in CONTRACTS[table]
            if f.name in have
        ]
    )


def same_type(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cast an id to string on both sides only when its types differ."""
    if left.schema[key].dataType == right.schema[key].dataType:
        return left, right
    text = F.col(key).cast("string")
    return left.withColumn(key, text), right.withColumn(key, text)
