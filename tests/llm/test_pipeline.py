import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, canonical
from limnos.llm import packing, queries, quality
from tests.llm import cases

DATA = "/root/testdata/sf0.001"


def plain(docs, items):
    """(doc_id, text) after the first four stages, by brute force; hosts of this table pass as a whole."""
    docs = [(i, t) for i, t in docs if not cases.measures(t)[-1]]
    roots = cases.classes([cases.fingerprint(t) for _, t in docs], 4)
    least = {}
    for (i, t), r in zip(docs, roots):
        least[r] = min(least.get(r, (i, t)), (i, t))
    docs = sorted(least.values())
    from collections import Counter
    found = [cases.words(t) for _, t in docs]
    starts = Counter(tuple(w[i:i + 35]) for w in found for i in range(len(w) - 34))
    cut = []
    for (i, _), w in zip(docs, found):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if starts[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        cut.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    hits = cases.contaminated([t for _, t in cut], items)
    return [d for d, h in zip(cut, hits) if not h[1]]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = plain(cases.pairs(docs), items)
    want = sorted((i, k, len(x[k * 4096:(k + 1) * 4096]), cases.crc(x[k * 4096:(k + 1) * 4096]))
                  for (i, _), x in zip(left, cases.word_ids([t for _, t in left])) for k in range(-(-len(x) // 4096)))
    got = corpus_pipeline.run(spark, DATA)
    assert cases.rows(got, "doc_id", "piece", "length", "ids_crc32") == sorted(want, key=repr)
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry.queries()


def test_stages_on_hard_rows(spark, tmp_path):
    clean = " ".join(f"clean{i}" for i in range(60))  # so many clean documents that no host is rejected
    docs = cases.documents(spark)
    more = spark.range(1000, 1120).selectExpr("id", f"concat('{clean} ', uuid(), ' ', uuid())", "CASE WHEN id % 2 = 0 THEN 'src0' END", "1L",
                                              *["'e'"] * len(cases.EXTRA))
    docs = docs.union(more)
    docs.write.parquet(str(tmp_path / "documents"))  # uuid() gives other texts each time
    docs = spark.read.parquet(str(tmp_path / "documents"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, DATA)
        assert docs.columns == cases.documents(spark).columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()
    empty = cases.documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(queries.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES) and quality.HOST_LIMIT == 0.5


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads /proc")
def test_workers_give_back_what_a_stage_has_used(tmp_path):
    """After 20 MB of text a worker holds little beside itself and the known words; in a process of its own, with one worker."""
    script = os.path.join(os.path.dirname(os.path.abspath(cases.__file__)), "worker_memory.py")
    said = subprocess.run([sys.executable, script, str(tmp_path)], capture_output=True, text=True, timeout=300)
    held = json.loads(said.stdout.rpartition("HELD")[2] or said.stderr[-2000:])
    assert max(held.values()) < 110, held


def test_packing_starts_no_other_python_workers(spark, tmp_path):
    """The intervals come as a local table; a list would pass through Python workers that the operators do not use."""
    made = spark.createDataFrame([(1, 0, 0, 7, 1, 0, 0)], packing.PIECES)
    made.write.parquet(str(tmp_path / "pieces"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "pieces")))
    assert "ExistingRDD" not in packed._jdf.queryExecution().optimizedPlan().toString() + packed._jdf.queryExecution().executedPlan().toString()
    assert [(r["sequence_id"], r["offset"]) for r in packed.collect()] == [(0, 0)]
