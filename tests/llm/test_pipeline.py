"""The pipeline on planted documents: every stage's decisions take effect, and clean documents come through."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm.store import staged

from .test_operators import DOCS, base_spans, brute_components, quality_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 4}") for i, t, _ in quality_rows()]
    clean = [t for _, t, q in quality_rows() if q]
    long_ = [t for t in clean if len(t.split()) > 100]
    items = [(i, " ".join(f"{w}{r.randrange(90)}" for w in clean[200 + i].split()[:40])) for i in range(5)]
    rows += [(1000 + i, long_[i] + " And one more end.", "en", "s1") for i in range(6)]  # near copies
    rows += [(1100 + i, f"{long_[10 + i]}\n{items[i][1]}\n{long_[20 + i]}", "en", "s2") for i in range(5)]  # benchmark passages
    rows += [(1200, f"{long_[30]} The token = abcdefghijklmnop9 is there. {long_[31]}", "en", "s3"), (1300, None, "en", None), (1301, "", None, "s1"), (1301, "", None, "s1")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    columns = tables[0].columns
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], folder), name))
        if name != "mixing":
            assert tables[-1].columns == columns, name
    before, quality, dedup, clean, redacted, mixed = ({r.doc_id: r for r in t.collect()} for t in tables)
    good = {i for i, _, q in quality_rows() if q}
    assert good <= set(quality) and len([i for i in quality if i < 300 and i not in good]) <= 5
    components = brute_components([(i, r.text) for i, r in quality.items()], 5, 8, 10)
    assert set(dedup) == {i for i, (_, c) in components.items() if i == c}
    assert not set(range(1000, 1006)) & set(dedup)
    assert set(dedup) - set(clean) == set(range(1100, 1105)) & set(dedup) and len(set(dedup) - set(clean)) == 5
    assert set(redacted) == set(clean) and "[SECRET]" in redacted[1200].text and redacted[1200].n_chars == len(redacted[1200].text)
    assert all(not base_spans(r.text) for r in redacted.values())
    assert all(r.text == clean[i].text for i, r in redacted.items() if not base_spans(clean[i].text) and "[SECRET]" not in (r.text or ""))
    assert set(mixed) == set(redacted) and all(0 <= r.taken <= 2 * r.size for r in mixed.values())
    assert 1300 in mixed and mixed[1300].taken == 0


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(out.collect()) == key(again.collect()) and "repetitions" in out.columns


def test_odd_tables(spark, folder, tmp_path):
    """Nothing, and columns of other names: every stage bears them, and all but the last keep the columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("key", "f", "id", "score", "gone_", "bad_", "base", "u"):
        docs = docs.withColumn(c, F.lit("x"))
    for table in (docs.limit(0), docs.where("doc_id >= 1200 or doc_id < 12")):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, table, folder), name)
            assert out.count() <= n and (name == "mixing" or out.columns == table.columns)
            table = out
