"""Whole runs, the console, sources, streams, and the catalogue against DuckDB."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

from tidewater.config import CleaningStrategy
from tidewater.operators.shared import numbered
from tidewater.plans import catalogue, console, pipeline
from tidewater.sources import files, jdbc
from tidewater.streaming import rowlocal

SF = "/root/testdata/sf0.001"


def test_clean_run(spark):
    rows = [(1, " raj sharma ", "Raj at mail.com", "+91 9876543210", "delhi", "$5"), (2, "Raj Sharma", "raj@mail.com", "9876543210", "Delhi", "7 EUR"), (3, "Meera Patel", "m@x.co", "9123456780", "pune", "12"), (4, None, None, None, None, None)]
    r = pipeline.clean(spark.createDataFrame(rows, "record_id int, name string, email string, phone string, city string, price string"), ["record_id"])
    got = {x["name"]: x for x in r.table.collect()}
    assert set(got) == {"Raj Sharma", "Meera Patel"} and got["Raj Sharma"]["email"] == "raj@mail.com"
    assert r.metadata["rows_in"] == 4 and r.metadata["rows_out"] == 2 and r.audit.count() > 0


def test_console(spark):
    spark.createDataFrame([(1, "a"), (2, "a")], "id int, s string").createOrReplaceTempView("console_t")
    c = console.Console(spark)
    assert c.run("SELECT s, count(*) AS n FROM console_t GROUP BY s").first()["n"] == 2
    assert c.run("SELECT count(*) AS n FROM console_t GROUP BY s, id").columns == ["n"]
    with pytest.raises(PermissionError):
        c.run("DROP TABLE console_t")
    assert console.is_destructive("select 1; create table x") and not console.is_destructive("select * from created")
    assert console.fix_group_by("SELECT * FROM t GROUP BY a") == "SELECT a, COUNT(*) as count FROM t GROUP BY a"
    assert console.alias_derived_tables("SELECT * FROM (SELECT (1) AS a) WHERE a = 1") == "SELECT * FROM (SELECT (1) AS a) AS t1 WHERE a = 1"
    assert console.table_names('SELECT * FROM "a" JOIN b') == ["a"]
    assert c.ask("how many rows in console_t", {"console_t": ["id", "s"]}).startswith("SELECT COUNT(*)")


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿ id , name\n1,NA\n2,x\n", encoding="utf-8")
    df = files.read(spark, str(path))
    assert df.columns == ["id", "name"] and [r["name"] for r in df.orderBy("id").collect()] == [None, "x"]
    files.write_csv(df, str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    files.save_session(df, {"a": 1, "password": "x"}, str(tmp_path / "s"))
    back, meta = files.load_session(spark, str(tmp_path / "s"))
    assert back.count() == 2 and meta == {"a": 1}
    with pytest.raises(ValueError):
        files.check_file("x.txt")
    assert jdbc.url_for("PostgreSQL", "d", "h") == "jdbc:postgresql://h:5432/d" and len(jdbc.DATABASES) == 9
    assert "password" not in repr(jdbc.Connector(spark, "SQLite", "f", password="secret")).replace("password=", "") and "secret" not in repr(jdbc.Connector(spark, "SQLite", "f", password="secret"))


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, " <b>Ann</b> ", "A at b.co"), (2, "bo", "x")], "id int, name string, email string")
    df.write.parquet(str(tmp_path / "in"))
    plan = {"name": CleaningStrategy("fill_none", "title_case", "fuzzy_name"), "email": CleaningStrategy("fill_none", "normalize_email", "none")}
    stream = rowlocal.clean_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), plan)
    rowlocal.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, rowlocal.clean_stream(df, plan).collect()))


def test_numbers_are_consecutive(spark):
    df = numbered(spark.range(1000).selectExpr("id * 7 % 1000 AS k"), ["k"])
    assert [(r["k"], r["_rid"]) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]


CHEAP = ["completeness", "exact_dup_count", "mixed_types", "clean_string", "title_case", "normalize_email", "normalize_phone", "parse_money", "fill_interpolate", "smart_rules", "cap_domain", "validation_score", "sorted_neighbourhood_pairs", "golden_record", "dedup_gov_id"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(rows):
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([show(v) for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(found)


def test_dedup_plan_has_no_cartesian_product(spark):
    from tidewater.operators import classify, dedup

    df = numbered(spark.createDataFrame([(i, f"n{i}", f"e{i}@x.co") for i in range(20)], "id int, name string, email string"), ["id"])
    engine = dedup.Engine(classify.tiers(df.columns))
    text = engine.candidates(engine.facts(df))._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop", text)


def test_works_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys, shutil; shutil.copytree({root!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('llm', '.git', 'corpus_pipeline.py')); sys.path.insert(0, {str(tmp_path / 'r')!r}); import __spark_entry__ as e; assert len(e.queries()) > 80 and e.llm is None and not any(k.startswith('op') for k in e.oracle_sql())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
