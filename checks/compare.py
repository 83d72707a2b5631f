"""Run registered queries against their SQL: ``python -m checks.compare [sf] [name part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from auditframe.session import build_session
from checks import ORACLES, QUERIES
from checks.registry import BASE_TABLES


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, names: list[str]) -> list[tuple[str, str]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = df.collect()
            took = time.time() - begin
            if name not in ORACLES:
                print(f"{name}: {len(got)} rows, {took:.2f}s, no SQL")
                continue
            cur = con.execute(ORACLES[name])
            columns = [d[0] for d in cur.description]
            want = _rows(columns, cur.fetchall())
            have = _rows(df.columns, got)
            types = {c: t for c, t in df.dtypes}
            if sorted(columns) != sorted(df.columns):
                failed.append((name, f"columns {sorted(df.columns)} vs {sorted(columns)}"))
            elif have != want:
                bad = next(((h, w) for h, w in zip(have, want) if h != w), None)
                failed.append((name, f"{len(have)} vs {len(want)} rows; first difference {bad}"))
            duck = dict((d[0], str(d[1])) for d in cur.description)
            note = {c: (types[c], duck[c]) for c in types if c in duck and not _same_type(types[c], duck[c])}
            print(f"{name}: {len(have)} rows, {took:.2f}s{'' if not failed or failed[-1][0] != name else '  FAILED'}"
                  f"{'  types ' + str(note) if note else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            failed.append((name, f"{type(e).__name__}: {str(e)[:600]}"))
            print(f"{name}: ERROR", flush=True)
    return failed


def _same_type(spark_type: str, duck_type: str) -> bool:
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    return names.get(spark_type, spark_type) == duck_type


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    chosen = [n for n in QUERIES if not parts or any(n.startswith(p) for p in parts)]
    session = build_session("compare", 8)
    problems = compare(session, f"/root/testdata/sf{sf}", chosen)
    for name, why in problems:
        print("FAILED", name, why)
    print(f"{len(chosen) - len(problems)} of {len(chosen)} agree")
