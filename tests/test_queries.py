import itertools
import subprocess
import sys
import tempfile

import pytest

from lociweave.plans import file_queries
from lociweave.plans import queries as Q
from lociweave.sources import fasta

from .conftest import ROOT
from .oracle import compare, runs


QUERIES, SQL = Q.queries() | file_queries.queries(), Q.ORACLE_SQL | file_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    runs(spark, QUERIES[name])


def test_projection_covers_all_embeddings(spark):
    """No vector whose number is a part key is left out."""
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(2000)], "vec_id int, embedding array<float>")
    li = spark.createDataFrame([(0, k, 1.0, 1) for k in range(1, 2501)], "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int")
    home = tempfile.mkdtemp(prefix="spark-")
    e.write.parquet(f"{home}/embeddings.parquet")
    li.write.parquet(f"{home}/lineitem.parquet")
    assert tuple(Q.queries()["embedding_counters"](spark, home).first()) == (2500, 1999, 501)
    got = {(r["idx"], r["dim"]): r["value"] for r in Q.queries()["embedding_projection"](spark, home).collect()}
    assert (got[0, 0], got[0, 1]) == (2 * sum(range(2000)), 2 * 1999)


def test_entry_without_the_training_data_operators():
    """The entry imports, and has the other queries, when the llm folder is not there."""
    code = "import sys; sys.modules['lociweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("name", ["fasta_line_kmers", "fasta_records", "fastq_records", "fastq_wrapped", "fastq_odd_qualities"])
def test_records_of_several_files(spark, name):
    """Files of a few ranges of the records: none is cut where a file ends."""
    one = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(one, "false")
    try:
        compare(spark, QUERIES[name], SQL[name])
    finally:
        spark.conf.unset(one)


@pytest.mark.parametrize("name", ["fasta_records", "fastq_records", "fastq_wrapped"])
def test_records_of_splits_that_change(spark, monkeypatch, name):
    """A file that is split otherwise from one job to the next, as when executors come or go, gives the same records."""
    splits, write = itertools.cycle((3, 11, 2, 7)), fasta.written

    def elsewhere(df):
        spark.conf.set("spark.sql.files.minPartitionNum", str(next(splits)))
        return write(df)

    monkeypatch.setattr(fasta, "written", elsewhere)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        compare(spark, QUERIES[name], SQL[name])
    finally:
        for c in ("openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")


@pytest.mark.parametrize("name", ["fastq_records", "fastq_wrapped"])
def test_files_of_records_go_once_they_are_read(spark, monkeypatch, name):
    """The disk of a query doesn't hold its text files beside the reader's tables, and no row is read from them any more."""
    paths, write = [], file_queries._written
    monkeypatch.setattr(file_queries, "_written", lambda *a: paths.append(write(*a)) or paths[-1])
    compare(spark, QUERIES[name], SQL[name])
    p = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert len(paths) == 1 and not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
