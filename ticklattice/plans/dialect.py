"""One text of a relational plan for Spark SQL and for standard SQL engines."""

from __future__ import annotations

import re
from collections import Counter

_SPARK = [(r"LASTV\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"last_value(\1) ignore nulls"), (r"IDIV\(([^,()]*(?:\([^()]*\)[^,()]*)*),([^()]*)\)", r"((\1) div (\2))"), (r"SERIES\((\w+),(\w+)\)", r"(select explode(sequence(\1, \2)) as i)")]
_PLAIN = [(r"LASTV\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"last_value(\1 ignore nulls)"), (r"FIRSTV\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"first_value(\1 ignore nulls)"), (r"IDIV\(([^,()]*(?:\([^()]*\)[^,()]*)*),([^()]*)\)", r"((\1) // (\2))"), (r"SERIES\((\w+),(\w+)\)", r"(select unnest(generate_series(\1, \2)) as i)")]


def _backward(m: re.Match) -> str:
    order = ", ".join(f"{c.strip()} desc" for c in m[1].split(","))
    return f"order by {order} rows between unbounded preceding and {'current row' if m[2] == 'current row' else '1 preceding'}"


#: Spark walks a frame that ends with its partition anew for each row; read backward it grows by a row at a time.
#: FIRSTV is only used over such frames.
_BACKWARD = [(r"order by (\w+(?:, *\w+)*) rows between (1 following|current row) and unbounded following", _backward), (r"\bFIRSTV\(", "LASTV(")]
_NAME = re.compile(r"\{(\w+)\}")


def occurrences(sql: str) -> Counter:
    return Counter(_NAME.findall(sql))


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def _turn(sql: str, rules: list) -> str:
    for pattern, new in rules:
        sql = re.sub(pattern, new, sql)
    return sql


def spark_sql(sql: str) -> str:
    return _turn(_turn(sql, _BACKWARD), _SPARK)


def plain_sql(sql: str) -> str:
    return _NAME.sub(r"\1", _turn(sql, _PLAIN))
