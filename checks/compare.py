"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [--dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

from checks.oracle import ORACLE
from checks.queries import REGISTERED
from vitrina.session import build_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, float):
            return (1, "nan" if math.isnan(v) else f"{v + 0.0:.9g}")
        return (1, str(v))

    return sorted(tuple(cell(v) for v in row) for row in rows)


def compare(spark, connection, name: str, sf_dir: str) -> str:
    """'ok', 'rows only' or a description of the difference."""
    start = time.time()
    frame = REGISTERED[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = canonical([tuple(r[c] for c in columns) for r in frame.collect()])
    took = f"{len(mine)} rows, {time.time() - start:.1f}s"
    if name not in ORACLE:
        return f"rows only ({took})"
    relation = connection.sql(ORACLE[name])
    if sorted(relation.columns) != columns:
        return f"DIFF columns {columns} != {sorted(relation.columns)}"
    order = [relation.columns.index(c) for c in columns]
    theirs = canonical([tuple(row[i] for i in order) for row in relation.fetchall()])
    if mine == theirs:
        return f"ok ({took}, sql {time.time() - start:.1f}s)"
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    return (
        f"DIFF {len(mine)} vs {len(theirs)} ({took})\n   columns {columns}\n   spark {only_mine}\n   sql   {only_theirs}\n   {kinds}"
    )


def connect(sf_dir: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session("checks", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(args.dir)
    bad = 0
    for name in args.names or list(REGISTERED):
        try:
            result = compare(spark, connection, name, args.dir)
        except Exception as error:  # report and go on with the next query
            text = str(error).strip().splitlines() or [repr(error)]
            result = "ERROR " + " | ".join(text[:4])
            if args.names:
                traceback.print_exc()
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name}: {result}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
