"""Runs queries beside their SQL: python tests/compare.py [-d DIR] [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings papers works research_info normalized_works chunks feeds").split()


def canonical(value):
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


#: Queries without SQL, with the test that holds them to brute force, hand-worked cases or an exact round trip.
CHECKED = {
    "p1_found": "test_split_values", "p1_values": "test_split_values", "fn_tidy_answers": "test_answers", "fn_checked_citations": "test_answers", "qo_embed_search": "test_answers (nearest)",
    **{n: "llm/test_llm" for n in ("p3_found", "p3_matches", "p4_found", "p4_repaired", "p5_found", "p5_survivors", "p5_golden", "p6_pieces", "p7_found", "p7_entities", "p8_ids", "p9_containers", "p9_fill", "p10_found")},
}


def compare(spark, name: str, sf_dir: str) -> str:
    """'' where both agree, else what differs; a query without SQL must be listed with its test."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in e.oracle_sql():
        return "" if name in CHECKED and mine[0] else "neither SQL nor a test"
    theirs = duck(e.oracle_sql()[name], sf_dir)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        return f"rows {len(mine[1])} / {len(theirs[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        sf, args = args[1], args[2:]
    spark, bad = session(), 0
    for n in args or e.queries():
        t = time.time()
        try:
            said = compare(spark, n, sf)
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok'} {n} {time.time() - t:.1f}s {'' if n in e.oracle_sql() else '(no SQL)'} {said}", flush=True)
    print("failed:", bad)
