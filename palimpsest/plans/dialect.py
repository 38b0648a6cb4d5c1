"""The few spellings that differ between Spark SQL and the oracle's SQL.

Fixture views are stated once and rendered for either engine, so that both
sides of a comparison start from the same rows.
"""

from __future__ import annotations


class SparkDialect:
    def __init__(self, folder: str):
        self.folder = folder

    def table(self, name):
        return f"parquet.`{self.folder}/{name}.parquet`"

    def array(self, *items):
        return f"array({', '.join(items)})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def empty(self, ddl):
        return f"CAST(array() AS array<{ddl}>)"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def json_int(self, x, key):
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"

    def hours(self, ts, n):
        return f"({ts} + make_dt_interval(0, CAST({n} AS INT)))"

    def minutes(self, ts, n):
        return f"({ts} + make_dt_interval(0, 0, CAST({n} AS INT)))"

    def map(self, k, v):
        return f"map({k}, {v})"

    def each_up_to(self, n):
        return f"explode(sequence(0, CAST({n} AS INT)))"


class OracleDialect(SparkDialect):
    def __init__(self):
        super().__init__("")

    def table(self, name):
        return name

    def array(self, *items):
        return f"list_value({', '.join(items)})"

    def struct(self, **fields):
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def empty(self, ddl):
        return "[]"

    def sha256(self, x):
        return f"sha256({x})"

    def json_int(self, x, key):
        return f"CAST(json_extract_string({x}, '$.{key}') AS BIGINT)"

    def hours(self, ts, n):
        return f"({ts} + to_hours(CAST({n} AS INT)))"

    def minutes(self, ts, n):
        return f"({ts} + to_minutes(CAST({n} AS INT)))"

    def map(self, k, v):
        return f"MAP([{k}], [{v}])"

    def each_up_to(self, n):
        return f"unnest(range(CAST({n} AS INT) + 1))"
