"""Batch loading with defaults, rules and parent checks: accepted rows and rejected rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.dates import moment
from keepsake.sources.tables import TABLES, ForeignKey, TableSpec


def _spec(spec: TableSpec | str) -> TableSpec:
    return TABLES[spec] if isinstance(spec, str) else spec


def _truthy(c: Column, kind: T.DataType) -> Column:
    """NULL where the value counts as not given: zero, or empty text."""
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, T.NumericType):
        return F.nullif(c, F.lit(0).cast(kind))
    return c


def apply_defaults(df: DataFrame, spec: TableSpec | str, as_of=None) -> DataFrame:
    """All columns of the table, typed, with its defaults in place of missing values.

    A column missing from ``df`` counts as not given. Only the listed columns treat zero and empty
    text as not given.
    """
    spec = _spec(spec)
    out = []
    for field in T._parse_datatype_string(spec.ddl).fields:
        name, kind = field.name, field.dataType
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in spec.falsy_to_default:
            value = _truthy(value, kind)
        default = spec.forced.get(name) or spec.defaults.get(name)
        if default == "as_of":
            if as_of is not None:
                value = F.coalesce(value, moment(as_of))
        elif name in spec.forced:
            value = F.expr(default).cast(kind)
        elif default is not None:
            value = F.coalesce(value, F.expr(default).cast(kind))
        out.append(value.alias(name))
    extra = [c for c in df.columns if c not in {f.name for f in T._parse_datatype_string(spec.ddl).fields}]
    return df.select(*out, *extra)


def rule_columns(spec: TableSpec | str) -> dict[str, Column]:
    """Rules of a table by name; as in a CHECK constraint, NULL passes every rule but ``required``."""
    spec = _spec(spec)
    rules = {f"{c} required": F.col(c).isNotNull() for c in spec.required}
    for c, legal in spec.enums.items():
        rules[f"{c} legal"] = F.coalesce(F.col(c).isin(*legal), F.lit(True))
    for c, (low, high) in spec.ranges.items():
        rules[f"{c} in range"] = F.coalesce(F.col(c).between(low, high), F.lit(True))
    return rules


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks."""
    broken = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    found = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return df.withColumn("violations", found)


def check_keys(child: DataFrame, parent: DataFrame, on: ForeignKey) -> tuple[DataFrame, DataFrame]:
    """(rows with an existing parent or a NULL reference, orphans)."""
    keys = parent.select(*on.parent_columns).distinct().toDF(*on.columns)
    first = on.columns[0]
    known = child.where(F.col(first).isNotNull()).join(keys, list(on.columns), "left_semi")
    return (known.unionByName(child.where(F.col(first).isNull())).select(*child.columns),
            child.where(F.col(first).isNotNull()).join(keys, list(on.columns), "left_anti")
            .select(*child.columns))


def checked(df: DataFrame, spec: TableSpec | str, parents: dict[str, DataFrame] | None = None,
            as_of=None) -> DataFrame:
    """Rows with defaults applied and ``violations`` filled, parent checks included.

    ``parents`` holds every table that the rows refer to, by name; None in its place skips that check.

    Each parent check is one left join against the parent's keys, so accepted and rejected rows come
    out of a single pass.
    """
    spec = _spec(spec)
    out = validate(apply_defaults(df, spec, as_of), rule_columns(spec))
    for key in spec.foreign_keys:
        if parents is None or key.parent not in parents:
            raise ValueError(f"{key.parent} is needed to check {', '.join(key.columns)}; pass None for it to skip the check")
        if parents[key.parent] is None:
            continue
        missing = [p for p in key.parent_columns if p not in parents[key.parent].columns]
        if missing:
            raise ValueError(f"{key.parent} has no {', '.join(missing)}")
        shared = list(zip(key.columns, key.parent_columns))
        keys = (parents[key.parent].select(*[F.col(p).alias(f"_{c}") for c, p in shared])
                .distinct().withColumn("_found", F.lit(True)))
        match = reduce(and_, [out[c] == keys[f"_{c}"] for c, _ in shared])
        orphan = F.col(key.columns[0]).isNotNull() & F.col("_found").isNull()
        note = F.when(orphan, F.array(F.lit(f"{key.columns[0]} has no parent in {key.parent}")))
        out = (out.join(keys, match, "left")
               .withColumn("violations", F.concat("violations", F.coalesce(
                   note, F.array().cast("array<string>"))))
               .drop("_found", *[f"_{c}" for c, _ in shared]))
    return out


def append_validated(df: DataFrame, spec: TableSpec | str, parents: dict[str, DataFrame] | None = None,
                     as_of=None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Load rows of one table: (accepted, rejected with their ``violations``).

    With ``path`` both are appended in one pass (partition column ``outcome``) and read back; without
    it the two lazy DataFrames are returned.
    """
    rows = checked(df, spec, parents, as_of)
    good = F.size("violations") == 0
    if path is not None:
        outcome = F.when(good, "accepted").otherwise("rejected")
        rows.withColumn("outcome", outcome).write.mode("append").partitionBy("outcome").parquet(path)
        table = df.sparkSession.read.parquet(path)
        return (table.where("outcome = 'accepted'").drop("outcome", "violations"),
                table.where("outcome = 'rejected'").drop("outcome"))
    return rows.where(good).drop("violations"), rows.where(~good)
