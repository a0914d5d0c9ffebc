"""Every query that has SQL, held against it on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry_module.queries() if n in entry_module.oracle_sql()]


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([plain(v.item() if hasattr(v, "item") else v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, sf, name):
    got = entry_module.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def odd_table(duck, folder, name, rows_sql):
    """A view of a small table, written in the order of its rows, in place of the driver's."""
    duck.execute(f"COPY ({rows_sql}) TO '{folder}/{name}.parquet'")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["gauge_latest", "gauge_merge", "event_json_gauge", "stat_select_gauge"])
def test_of_events_at_one_time_the_first_is_latest(spark, duck, tmp_path, name):
    at = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (i * 40 // 400 * 20) MINUTE"
    value = "CASE WHEN i < 290 THEN CAST(i * 7 % 10 AS DOUBLE) END"
    con = odd_table(duck, tmp_path, "events", f"SELECT i AS event_id, {at} AS ts, i % 2 AS user_id, 'view' AS event_type, {value} AS value, '{{}}' AS props FROM range(300) r(i) ORDER BY i")
    assert rows(entry_module.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(entry_module.oracle_sql()[name]).df())


def test_writes_with_nulls_and_fractions(spark, duck, tmp_path):
    con = odd_table(
        duck, tmp_path, "lineitem",
        "SELECT i AS l_orderkey, CAST(1 AS INT) AS l_linenumber, i // 4 AS l_suppkey, i / 4 AS l_quantity, CASE WHEN i % 5 <> 0 THEN 'A' END AS l_returnflag, CASE WHEN i % 7 <> 0 THEN 'F' END AS l_linestatus, TIMESTAMP '1999-05-06' AS l_shipdate FROM range(80) r(i) ORDER BY i",
    )
    for name in ("raw_dedup_lww", "counter_from_raw"):
        assert rows(entry_module.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(entry_module.oracle_sql()[name]).df())


def test_of_writes_with_equal_keys_the_first_stands(spark, duck, tmp_path):
    """Two files, of which Spark reads the larger one first."""
    (tmp_path / "lineitem.parquet").mkdir()
    for part, start, stop in ((0, 0, 8), (1, 8, 4000)):
        odd_table(
            duck, tmp_path / "lineitem.parquet", f"part-{part}",
            f"SELECT 7 AS l_orderkey, CAST(1 AS INT) AS l_linenumber, i % 4 AS l_suppkey, CAST(i AS DOUBLE) AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1999-05-06' AS l_shipdate FROM range({start}, {stop}) r(i) ORDER BY i",
        )
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = rows(con.execute(entry_module.oracle_sql()["raw_dedup_lww"]).df())
    assert [w[-1] for w in want] == ["0.0000", "1.0000", "2.0000", "3.0000"]
    assert rows(entry_module.queries()["raw_dedup_lww"](spark, str(tmp_path)).toPandas()) == want


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_library_does_not_import_the_corpus_operators():
    import ast
    from pathlib import Path

    root = Path(entry_module.__file__).parent / "tidegauge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
