"""Row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        number = float(v)
        return int(number) if number.is_integer() else float(f"{number:.9g}")
    return str(v)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_value(t[i]) for i in order) for t in tuples)


def spark_rows(df):
    return rows(df.columns, (tuple(r) for r in df.collect()))


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(spark_side, duck_side) -> str:
    (a_names, a), (b_names, b) = spark_side, duck_side
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if a != b:
        left, right = a - b, b - a
        return f"{sum(a.values())} vs {sum(b.values())} rows; only Spark {sum(left.values())} {list(left)[:2]}; only DuckDB {sum(right.values())} {list(right)[:2]}"
    return ""
