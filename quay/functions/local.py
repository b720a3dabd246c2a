"""Small constant tables as local relations: the optimizer knows their size and folds what is done to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"{x!r}D" if isinstance(x, float) else str(x)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case: helper columns never meet a user's."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``schema`` is a list of simple columns, such as ``a string, n int``."""
    names = [c.split() for c in schema.split(",")]
    shown = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) if rows else "(" + ", ".join("NULL" for _ in names) + ")"
    cast = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(names))
    return spark.sql(f"SELECT {cast} FROM VALUES {shown} AS t({', '.join(f'c{i}' for i in range(len(names)))})" + ("" if rows else " WHERE false"))
