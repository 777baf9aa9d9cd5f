"""Every query of the analyses against its oracle, and the entry points."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from codonframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(catalog.oracle_sql()[name])
    found = catalog.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(expected.columns)
    assert ordered(found.columns, found.collect()) == ordered(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_long_sequence_of_odd_texts(spark, tmp_path):
    """Texts are read once, before the result's plan, and letters that capitals turn into several are left out, as in SQL."""
    texts = [None, "", "\ufb05\ufb06 cat \u1e97ag", "no\nbases? \u00df" * 3, *(f"A{'cgt' * k}\ttTg\u00e4C {k}" for k in range(30))]
    spark.createDataFrame([(90 + 7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("fasta_long", "fasta_long_sites", "revcomp"):
        expected, found = con.sql(catalog.oracle_sql()[name]), catalog.queries()[name](spark, str(tmp_path))
        assert ordered(found.columns, found.collect()) == ordered(expected.columns, expected.fetchall())
        assert name == "revcomp" or not any("documents.parquet" in f for f in found.inputFiles())


def test_significance_belongs_to_the_whole_group(spark):
    """n is every row of a supplier, and D is that of n."""
    con = duckdb.connect()
    sizes = dict(con.sql(f"SELECT l_suppkey, count(*) FROM '{DATA}/lineitem.parquet' GROUP BY 1 HAVING count(*) > 1").fetchall())
    inputs = {i: (s, k) for i, s, k in con.sql(f"SELECT l_suppkey, count(DISTINCT l_partkey) % 97 + 1, (sum(l_linenumber) % 1000) / 37.0 FROM '{DATA}/lineitem.parquet' GROUP BY 1").fetchall()}
    rows = catalog.queries()["tajima_sig"](spark, DATA).collect()
    assert {r.id: r.n for r in rows} == sizes and len(set(sizes.values())) > 1
    for r in rows:
        n, (s, k) = r.n, inputs[r.id]
        a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
        e1, e2 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)
        assert s == r.s and abs((float(k) - s / a1) / (e1 * s + e2 * s * (s - 1)) ** 0.5 - r.D) < 1e-5


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_can_be_named_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and len(e.oracle_sql()) > 40"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
