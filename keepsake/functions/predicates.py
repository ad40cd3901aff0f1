"""Boolean column predicates: substring search, tag containment, document containment."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC_TYPES = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_pattern(q: str) -> str:
    # A backslash before an ordinary character means that character; Spark's LIKE rejects it.
    return re.sub(r"\\([^%_\\])", r"\1", f"%{q}%")


def ilike_contains(c, q: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` inside ``q`` stay wildcards."""
    return F.coalesce(_col(c).ilike(_contains_pattern(q)), F.lit(False))


def ilike_any(cols, q: str) -> Column:
    """True when any of the columns contains ``q``; a NULL column never matches."""
    return reduce(or_, [ilike_contains(c, q) for c in cols])


def contains_all(c, tags) -> Column:
    """True when the array column holds every given tag; NULL arrays never match."""
    wanted = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    return F.coalesce(F.size(F.array_except(wanted, _col(c))) == 0, F.lit(False))


def has_ingredient_named(c, name: str) -> Column:
    """True when some ingredient struct has exactly this name (case-sensitive)."""
    return F.coalesce(F.exists(_col(c), lambda x: x["name"] == F.lit(name)), F.lit(False))


def _key_path(key: str) -> str:
    quote = '"' if "'" in key else "'"
    return f"$[{quote}{key}{quote}]"


def _type_is(v: Column, *names: str) -> Column:
    kind = F.schema_of_variant(v)
    return reduce(or_, [kind.startswith(n) for n in names])


def _some_holds(items: Column, wanted) -> Column:
    return F.exists(items, lambda x: _holds(x, wanted))


def _holds(v: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        parts = [_type_is(v, "OBJECT")]
        parts += [_holds(F.variant_get(v, _key_path(k), "variant"), w) for k, w in wanted.items()]
        test = reduce(and_, parts)
    elif isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(v, "$", "array<variant>")
        parts = [_type_is(v, "ARRAY")]
        parts += [_some_holds(items, w) for w in wanted]
        test = reduce(and_, parts)
    elif wanted is None:
        test = F.is_variant_null(v)
    elif isinstance(wanted, bool):
        test = _type_is(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, int):
        test = _type_is(v, *_NUMERIC_TYPES) & (
            F.try_variant_get(v, "$", "decimal(38,9)") == F.lit(str(wanted)).cast("decimal(38,9)"))
    elif isinstance(wanted, float):
        test = _type_is(v, *_NUMERIC_TYPES) & (F.try_variant_get(v, "$", "double") == F.lit(wanted))
    else:
        test = _type_is(v, "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(wanted))
    return F.coalesce(test, F.lit(False))


def json_contains(doc, wanted: dict, promoted: dict | None = None, is_variant: bool = False) -> Column:
    """Document containment: every key and element of ``wanted`` is found in ``doc``.

    Objects are compared key by key, arrays element by element (each wanted element must be
    contained in some element), scalars by type and value. An empty filter keeps every row.
    ``doc`` is a JSON text column, or a Variant column with ``is_variant=True``. ``promoted`` maps
    a top-level key to a typed column holding the same value; such tests become plain column
    equalities that reach the Parquet scan.
    """
    if not wanted:
        return F.lit(True)
    promoted = promoted or {}
    rest = {k: w for k, w in wanted.items() if k not in promoted}
    # Null-safe equality is a plain predicate that Parquet can evaluate.
    tests = [_col(promoted[k]).eqNullSafe(F.lit(w)) for k, w in wanted.items() if k in promoted]
    if rest:
        tests.append(_holds(_col(doc) if is_variant else F.try_parse_json(_col(doc)), rest))
    return reduce(and_, tests)
