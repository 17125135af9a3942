import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["chrom1", "chrom2", "n"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still has all other queries."""
    import shutil

    for name in ("__spark_entry__.py", "pairloom"):
        copy = shutil.copytree if os.path.isdir(os.path.join(ROOT, name)) else shutil.copy
        copy(os.path.join(ROOT, name), tmp_path / name)
    shutil.rmtree(tmp_path / "pairloom" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    assert "flagship" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


@needs_data
@pytest.mark.parametrize("name", ["flagship", "flip_triu", "stats_flatten_long", "dedup_candidate_edges", "scaling_trans", "stream_dedup", "scan_pairs", "parse_pairs"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = db.execute(f"select {quoted} from ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda rows: sorted((tuple(float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows), key=repr)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(expected)


@needs_data
def test_every_line_is_an_alignment_of_its_molecule(spark):
    from pairloom.plans import extra

    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    walks = extra._walks(spark, DATA)
    assert walks.count() == lines.count()
    assert {r.cigar for r in walks.where("cigar <> '*'").select("cigar").distinct().collect()} == {"20M60S", "20S20M40S", "40S20M20S", "60S20M"}


@needs_data
def test_all_pairs_are_sorted_and_zipped(spark, monkeypatch):
    from pairloom.plans import catalog, extra

    written = []
    write = extra.files.write_pairs
    monkeypatch.setattr(extra.files, "write_pairs", lambda table, *a, **b: (written.append(table.df.count()), write(table, *a, **b)))
    n = catalog.pairs(spark, DATA).count()
    assert entry.queries()["sort_gzip"](spark, DATA).count() == n and written == [n]


@needs_data
def test_runs_without_the_training_data_subpackage(tmp_path):
    import shutil

    for name in ("__spark_entry__.py", "pairloom"):
        copy = shutil.copytree if os.path.isdir(os.path.join(ROOT, name)) else shutil.copy
        copy(os.path.join(ROOT, name), tmp_path / name)
    shutil.rmtree(tmp_path / "pairloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('rows', e.entry(s).count(), e.queries()['walk_policy_all'](s, '" + DATA + "').count() > 0)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert "rows 5 True" in out.stdout, out.stderr[-2000:]


@needs_data
def test_sorted_gzip_is_dealt_over_files(spark):
    """No task bears the whole table; the files one after another are one sorted gzip file."""
    import gzip
    from urllib.parse import unquote, urlparse

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = entry.queries()["sort_gzip"](spark, DATA)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(unquote(urlparse(f).path) for f in got.inputFiles())
    assert len(files) > 1 and all(f.endswith(".gz") for f in files)
    lines = gzip.decompress(b"".join(open(f, "rb").read() for f in files)).decode().splitlines()
    keys = [(f[1], f[3], int(f[2]), int(f[4]), f[7], f[0]) for f in (x.split("\t") for x in lines)]
    assert keys == sorted(keys) and len(keys) == got.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
