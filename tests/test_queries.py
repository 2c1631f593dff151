"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from burin.functions import text as T
from burin.operators import convert, pdf_files
from burin.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(duck):
    for t in TABLES:
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    duck.execute("SET TimeZone = 'UTC'")
    return duck


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    found = tables.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())


def test_conversions_take_whole_texts(spark, tables):
    got = dict(tables.execute("SELECT doc_id, coalesce(length(text), 0) FROM documents").fetchall())
    turned = registry.queries()["convert_matrix"](spark, SF).where("conversion = 'rot13'").selectExpr("doc_id", "coalesce(length(result), 0) AS n")
    assert max(got.values()) > 80 and {r["doc_id"]: r["n"] for r in turned.collect()} == got


def test_sizes_over_a_thousand_gigabytes(spark, duck, tmp_path):
    duck.execute(f"CREATE OR REPLACE TABLE large_orders AS SELECT unnest([0, 3, 170000, 172384, 172385, 900000, 9000000])::BIGINT AS o_orderkey; COPY large_orders TO '{tmp_path}/orders.parquet'")
    want = duck.execute(registry.oracle_sql()["format_bytes"].replace("FROM orders", "FROM large_orders")).fetchall()
    got = [tuple(r) for r in registry.queries()["format_bytes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (172385, "1024 GB") in got
    assert spark.range(1).select(T.format_bytes(F.lit(1 << 41))).first()[0] == "2 TB"


def test_texts_of_blanks_go_through_a_document(spark, duck, tmp_path):
    texts = [None, "", " \n", "a", "\u00a0a\u2003", " \u3000a\x1f\t", "\x0b\x0c", "\x85a\ufeff", "&lt;\r\n</w:p>\n\n\n&amp;"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck.execute(f"CREATE OR REPLACE VIEW blank_documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(registry.oracle_sql()["docx_roundtrip"].replace("FROM documents", "FROM blank_documents")).fetchall()
    assert sorted(tuple(r) for r in registry.queries()["docx_roundtrip"](spark, str(tmp_path)).collect()) == sorted(want)


def test_one_worker_a_task_reorders_pages(spark, tables):
    df = registry.queries()["pdf_reorder"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    texts = spark.createDataFrame([("\n".join(map(str, range(100))),), ("one",), ("",), (None,)], "t string")
    got = [tuple(r) for r in texts.select(pdf_files.reordered_text(F.col("t"), lambda n: list(range(n, 0, -1))).alias("c")).select("c.*").collect()]
    pages = ["\n".join(map(str, range(a, b))) for a, b in ((96, 100), (48, 96), (0, 48))]
    assert got == [(3, "\n\n".join(pages), None), (1, "one", None), (None, None, "Se necesita un archivo"), (None, None, "Se necesita un archivo")]


def test_matrix_computes_each_conversion_once(spark):
    texts = [None, "", "\u00a0 XIV\ufeff", "0XfF", "#AbC", "HSL(10, 20%, 30%)", "hTTPServerÉa9Bc\u2003x", "mcmß", "x\u0131v", "aG9s\u3000YQ==", "Jan 2, 2024", "2024-01-02", "|a|b|\n|-|-|\n|1|2|", "# t\u2028 - **x**"]
    ids = [c for c in convert.EXPRESSIONS if c != "uuid-v4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = convert.all_converted(rows, "text", ids)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(split(") == plan.count("translate(") == 1
    got = {(r["doc_id"], r["conversion"]): (r["result"], r["error"]) for r in made.collect()}
    assert len(got) == len(texts) * len(ids)
    for c in ids:
        for r in rows.select("doc_id", convert.convert(F.col("text"), c).alias("c")).select("doc_id", "c.*").collect():
            result = bytes(r["result"]).hex().upper() if isinstance(r["result"], (bytes, bytearray)) else r["result"]
            assert got[r["doc_id"], c] == (result, r["error"]), (texts[r["doc_id"]], c)


def test_entry_imports_without_the_optional_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rot13' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
