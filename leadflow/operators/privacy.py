"""Personal-data removal and detection over arbitrary (nested) schemas.

The schema is walked on the driver (schemas are small); the data itself is
rewritten by native expressions: ``dropFields`` on structs, ``transform``
over arrays and ``map_filter`` on map keys, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from leadflow.functions.domains import PII_FIELDS


def _map_keys_text(dt: MapType) -> bool:
    from pyspark.sql.types import StringType
    return isinstance(dt.keyType, StringType)


def _only(dt: DataType, pii: set[str]) -> bool:
    """A struct (or an array of structs) of nothing but personal fields: it is
    dropped as a whole, since a struct without fields cannot be stored."""
    if isinstance(dt, ArrayType):
        return _only(dt.elementType, pii)
    return isinstance(dt, StructType) and all(f.name in pii or _only(f.dataType, pii) for f in dt.fields)


def _clean(c: Column, dt: DataType, pii: set[str]) -> Column:
    if isinstance(dt, StructType):
        drop = [f.name for f in dt.fields if f.name in pii or _only(f.dataType, pii)]
        keep = [f for f in dt.fields if f.name not in drop]
        out = c.dropFields(*drop) if drop else c
        for f in keep:
            if _needs(f.dataType, pii):
                out = out.withField(f.name, _clean(c.getField(f.name), f.dataType, pii))
        return out
    if isinstance(dt, ArrayType):
        return F.transform(c, lambda x: _clean(x, dt.elementType, pii))
    if isinstance(dt, MapType):
        m = c
        if _map_keys_text(dt):
            m = F.map_filter(m, lambda k, v: ~k.isin(list(pii)))
        if _needs(dt.valueType, pii):
            m = F.transform_values(m, lambda k, v: _clean(v, dt.valueType, pii))
        return m
    return c


def _needs(dt: DataType, pii: set[str]) -> bool:
    if isinstance(dt, StructType):
        return any(f.name in pii or _needs(f.dataType, pii) for f in dt.fields)
    if isinstance(dt, ArrayType):
        return _needs(dt.elementType, pii)
    if isinstance(dt, MapType):
        return _map_keys_text(dt) or _needs(dt.valueType, pii)
    return False


def strip_pii(df: DataFrame, fields: Iterable[str] = PII_FIELDS) -> DataFrame:
    """drop every column, nested struct field and map entry named as
    personal data, at any depth."""
    pii = set(fields)
    cols = []
    for f in df.schema.fields:
        if f.name in pii or _only(f.dataType, pii):
            continue
        cols.append(_clean(F.col(f.name), f.dataType, pii).alias(f.name)
                    if _needs(f.dataType, pii) else F.col(f.name))
    return df.select(*cols)


def pii_paths(schema: StructType, fields: Iterable[str] = PII_FIELDS, prefix: str = "") -> list[str]:
    """Column paths (``a.b``, ``arr[].x``, ``m{}``) that can hold personal data."""
    pii = set(fields)
    out: list[str] = []

    def walk(dt: DataType, path: str) -> None:
        if isinstance(dt, StructType):
            for f in dt.fields:
                p = f"{path}.{f.name}" if path else f.name
                if f.name in pii:
                    out.append(p)
                walk(f.dataType, p)
        elif isinstance(dt, ArrayType):
            walk(dt.elementType, f"{path}[]")
        elif isinstance(dt, MapType):
            if _map_keys_text(dt):
                out.append(f"{path}{{}}")
            walk(dt.valueType, f"{path}{{}}")

    walk(schema, prefix)
    return out


def _any_of(items: Column, dt: DataType, pii: set[str], path: str) -> list[tuple[str, Column]]:
    """An array holds personal data at a path if any element does."""
    def at(i: int) -> Column:
        return F.exists(items, lambda x: F.coalesce(_holders(x, dt, pii, path)[i][1], F.lit(False)))

    return [(p, at(i)) for i, (p, _) in enumerate(_holders(items.getItem(0), dt, pii, path))]


def _holders(c: Column, dt: DataType, pii: set[str], path: str) -> list[tuple[str, Column]]:
    """(path, whether this value holds personal data there) for every path below."""
    out: list[tuple[str, Column]] = []
    if isinstance(dt, StructType):
        for f in dt.fields:
            p = f"{path}.{f.name}" if path else f.name
            if f.name in pii:
                out.append((p, c.getField(f.name).isNotNull()))
            out += _holders(c.getField(f.name), f.dataType, pii, p)
    elif isinstance(dt, ArrayType):
        out += _any_of(c, dt.elementType, pii, f"{path}[]")
    elif isinstance(dt, MapType):
        if _map_keys_text(dt):
            out.append((f"{path}{{}}", F.exists(F.map_keys(c), lambda k: k.isin(sorted(pii)))))
        out += _any_of(F.map_values(c), dt.valueType, pii, f"{path}{{}}")
    return out


def pii_report(df: DataFrame, fields: Iterable[str] = PII_FIELDS) -> DataFrame:
    """F16: per path that can hold personal data, how many rows carry a value
    there, at any depth, in one aggregation pass. A text-keyed map is listed
    only if some row has a personal key in it."""
    pii = set(fields)
    found: list[tuple[str, Column]] = []
    for f in df.schema.fields:
        if f.name in pii:
            found.append((f.name, F.col(f.name).isNotNull()))
        found += _holders(F.col(f.name), f.dataType, pii, f.name)
    if not found:
        return df.sparkSession.createDataFrame([], "path string, rows_with_value long")
    counts = df.agg(*[F.count_if(has).alias(f"p{i}") for i, (_, has) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(path).alias("path"), F.col(f"p{i}").alias("rows_with_value"))
                     for i, (path, _) in enumerate(found)])
    return (counts.select(F.inline(rows))
            .filter(~(F.col("path").endswith("{}") & (F.col("rows_with_value") == 0))))
