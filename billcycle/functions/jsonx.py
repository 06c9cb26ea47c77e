"""JSON columns: one parse per row, string leaves, then ``try_cast``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pruned_schema(paths: Iterable[str]) -> T.StructType:
    """Struct holding only the dotted ``paths``, every leaf a string.

    String leaves keep quoted numbers and let a bad value turn into NULL in the later ``try_cast``
    instead of failing the job.
    """
    heads: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        heads.setdefault(head, [])
        if rest:
            heads[head].append(rest)
    return T.StructType(
        [T.StructField(h, pruned_schema(rest) if rest else T.StringType()) for h, rest in heads.items()]
    )


def json_value(json_col: str | Column, path: str, dtype: str = "string") -> Column:
    """One value of a JSON column; for several values of one column use :func:`parse_json`."""
    value = F.from_json(json_col, pruned_schema([path]))
    for part in path.split("."):
        value = value.getField(part)
    return value if dtype == "string" else value.try_cast(dtype)


def typed(value: str, dtype: str) -> str:
    """SQL text of a string value as ``dtype``, NULL if it is none. A whole number may be written ``3.0``."""
    if dtype not in ("int", "bigint"):
        return f"try_cast({value} as {dtype})"
    exact = f"try_cast({value} as decimal(38,6))"
    return f"if({exact} = floor({exact}), try_cast({exact} as {dtype}), null)"


def parse_json(
    df: DataFrame, json_col: str, fields: dict[str, tuple[str, str]], required: dict[str, str | None] | None = None
) -> DataFrame:
    """Replace ``json_col`` by typed columns ``{name: (path, type)}``.

    ``required`` filters on raw values before any cast: ``{name: None}`` asks for a present value,
    ``{name: text}`` for equality. The document is opened with ``inline`` so that those filters are
    evaluated on the parsed values. Over a plain projection Catalyst would substitute the parse
    into the filter and read each document twice (22 s against 13 s on 4 million documents).
    """
    keep = [c for c in df.columns if c != json_col]
    document = F.from_json(json_col, pruned_schema(path for path, _ in fields.values()))
    opened = df.select(*keep, F.inline(F.array(F.struct(document.alias("_json")))))
    for name, wanted in (required or {}).items():
        raw = F.col(f"_json.{fields[name][0]}")
        opened = opened.where(raw.isNotNull() if wanted is None else raw == wanted)
    return opened.selectExpr(*keep, *[f"{typed(f'_json.{path}', dtype)} as {name}" for name, (path, dtype) in fields.items()])
