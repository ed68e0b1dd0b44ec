"""Run catalog queries and their SQL side by side.

    python tests/compare.py /root/testdata/sf0.01 [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


_KINDS = {
    "int": "int", "bigint": "int", "integer": "int", "hugeint": "int", "smallint": "int", "double": "double",
    "decimal": "decimal", "string": "text", "varchar": "text", "boolean": "bool", "date": "date", "timestamp": "time",
}


def kind(type_name: str) -> str:
    name = type_name.lower().split("(")[0]
    return _KINDS.get(name, name)


def differences(spark_df, relation) -> list[str]:
    """What differs between a Spark result and a DuckDB relation, up to a few rows."""
    ours = sorted(spark_df.columns)
    theirs = sorted(relation.columns)
    if ours != theirs:
        return [f"columns {ours} vs {theirs}"]
    left_kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    right_kinds = dict(zip(relation.columns, map(str, relation.types)))
    found = [
        f"type of {c}: {left_kinds[c]} vs {right_kinds[c]}" for c in ours if kind(left_kinds[c]) != kind(right_kinds[c])
    ]
    found += [f"width of {c}: {left_kinds[c]} vs {right_kinds[c]}" for c in ours if "HUGE" in right_kinds[c]]
    left = sorted(repr(tuple(r[c] for c in ours)) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in ours]
    right = sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())
    if len(left) != len(right):
        found.append(f"{len(left)} rows vs {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        found.append(f"only ours: {sorted(a - b)[:2]}; only theirs: {sorted(b - a)[:2]}")
    return found


def main() -> int:
    from tsubo.plans.catalog import CATALOG
    from tsubo.session import local_session

    folder, wanted = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name, e in CATALOG.items():
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            frame = e.run(spark, folder)
            problems = differences(frame, con.sql(e.sql)) if e.sql else []
            note = "" if e.sql else f"no SQL, {frame.count()} rows"
        except Exception as error:  # report and go on to the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.1f}s {problems or note}", flush=True)
    print("bad", bad, "of", len(CATALOG))
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
