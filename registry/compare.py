"""Compare a registered query with its DuckDB equivalent.

    python -m registry.compare [folder] [query ...]
"""

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle_rows(folder, sql):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def value(v):
        return repr(float(v)) if isinstance(v, float) else repr(v)
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(df, folder, sql):
    """Empty string when equal, else a short description."""
    have = _canonical(df.columns, [tuple(r) for r in df.collect()])
    want = _canonical(*oracle_rows(folder, sql))
    if have[0] != want[0]:
        return f"columns {have[0]} != {want[0]}"
    if have[1] == want[1]:
        return ""
    missing = sorted(set(want[1]) - set(have[1]))[:2]
    extra = sorted(set(have[1]) - set(want[1]))[:2]
    return f"rows {len(have[1])} != {len(want[1])}; missing {missing}; extra {extra}"


def main(argv):
    from lexiframe.session import local_session
    import registry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8, "compare")
    oracles = registry.all_oracles()
    failed = 0
    for name, query in registry.all_queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                diff = differences(df, folder, oracles[name])
                rows = df.count() if diff == "" else -1
            else:
                rows, diff = df.count(), ""
        except Exception as error:  # report and go on with the next query
            rows, diff = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += diff != ""
        kind = "oracle" if name in oracles else "rows only"
        print(f"{'FAIL' if diff else 'ok  '} {name} ({kind}) rows={rows} {time.time() - start:.1f}s {diff[:3000]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
