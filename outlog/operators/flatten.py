"""Flatten nested JSON records into dotted leaf columns (schema driven, no data pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import fill_empty, template, to_str


def leaf_paths(schema: StructType, prefix: tuple = ()) -> list[tuple[tuple, object]]:
    out = []
    for f in schema.fields:
        path = prefix + (f.name,)
        if isinstance(f.dataType, StructType):
            out.extend(leaf_paths(f.dataType, path))
        else:
            out.append((path, f.dataType))
    return out


def _ref(path: tuple):
    return F.col(".".join(f"`{p}`" for p in path))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs become ``a<sep>b`` columns; arrays and scalars are kept as they are."""
    cols = [_ref(p).alias(sep.join(p)) for p, _ in leaf_paths(df.schema)]
    return df.select(*cols)


def prepare_columns(df: DataFrame, message_col: str = "message", keep: tuple = ()) -> DataFrame:
    """Per-column preparation before encoding.

    ``message`` becomes its letters-only template; every other column becomes a string
    (lists joined by spaces).  Missing values become ``EMPTY`` before cleaning, so a null
    never reaches the cleaner.  Columns in ``keep`` pass through untouched.
    """
    out = []
    for f in df.schema.fields:
        name = f.name
        ref = F.col(f"`{name}`")
        if name in keep:
            out.append(ref)
        elif name == message_col:
            out.append(template(fill_empty(ref)).alias(name))
        else:
            out.append(fill_empty(to_str(ref, f.dataType)).alias(name))
    return df.select(*out)


def flatten_json_column(df: DataFrame, col: str, schema: str | StructType, sep: str = ".",
                        keep_original: bool = False) -> DataFrame:
    """Parse a JSON string column with a known schema and flatten its fields next to the rest."""
    parsed = df.withColumn("__json", F.from_json(F.col(col), schema))
    st = parsed.schema["__json"].dataType
    leaves = [(_ref(("__json",) + p).alias(sep.join((col,) + p))) for p, _ in leaf_paths(st)]
    base = [F.col(f"`{c}`") for c in df.columns if keep_original or c != col]
    return parsed.select(*base, *leaves)


def is_list_type(dt) -> bool:
    return isinstance(dt, ArrayType)
