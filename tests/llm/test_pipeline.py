"""Each stage on what the one before it kept, against brute force."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from matrixframe.llm import langid
from matrixframe.llm.common import BATCH_BYTES
from tests.llm.conftest import as_set
from tests.llm.test_joins import brute
from tests.llm.test_models import brute_base, check_packed

ROOT = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    extra = [(100 + i, "the river password=0123456789abcdef runs past " + f"house{i} " * 5, "en", "b", 60) for i in range(3)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def results(spark, tables, tmp_path_factory):
    out = [spark.read.parquet(f"{tables}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], tables).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_and_columns(results):
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources", "best-fit packing"]
    for df in results[:-1]:
        assert df.columns == list(cp.COLUMNS)


def test_rejected_languages_go_and_the_rest_stays(results):
    before, after = (Counter(map(tuple, r.collect())) for r in results[:2])
    told = langid.identify(results[0], langid.train(results[0]))
    assert after == Counter(map(tuple, told.where("accepted").select(*cp.COLUMNS).collect())) and not after - before
    assert all(any(map(str.isalpha, r[1])) for r in after)


def test_one_document_of_each_group_stays(results):
    before, after = (list(map(tuple, r.collect())) for r in results[1:3])
    least = brute([(r[0], r[1]) for r in before])
    kept = {i for i, _, c in least if i == c and i is not None}
    assert {r[0] for r in after if r[0] is not None} == kept
    assert set(after) <= set(before)
    alone = {i for i, (_, _, c) in enumerate(brute([(None, r[1]) if r[0] is None else (r[0], r[1]) for r in before])) if c is None}
    assert sum(r[0] is None for r in after) <= len(alone)
    assert max(Counter((r[0], r[1]) for r in after).values()) == 1


def test_secrets_are_replaced(results):
    before = {(r[0], r[1]): r for r in results[2].collect()}
    after = results[3].collect()
    assert len(before) == len(after)
    assert not any(brute_base(r["text"]) for r in after)
    clean = {k for k in before if not brute_base(k[1])}
    assert {(r["doc_id"], r["text"]) for r in after} >= clean
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] and "[assign]" in r["text"])


def test_mix_repeats_rows(results):
    before, after = (Counter(map(tuple, r.collect())) for r in results[3:5])
    assert set(after) <= set(before) and max(after[r] / before[r] for r in after) <= 3


def test_all_mixed_rows_are_packed(results):
    check_packed(results[5].collect(), [(r[0], r[1]) for r in results[4].collect()])


def test_run_equals_its_stages(spark, tables, results):
    assert Counter(as_set(cp.run(spark, tables).drop("sequence_id", "offset"))) == Counter(as_set(results[5].drop("sequence_id", "offset")))


@pytest.mark.parametrize("stage", [cp.known_language, cp.distinct_documents, cp.without_secrets, cp.packed_sequences])
def test_batches_for_python_are_cut_by_bytes(spark, docs, tables, stage):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage(spark, docs, tables)
    long = spark.range(0, 400, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("word "), 10_000)).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) <= BATCH_BYTES + 60_000


def test_a_lower_limit_of_the_session_stays(spark, docs, tables):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, 1 << 20)
    cp.known_language(spark, docs, tables)
    assert int(spark.conf.get(name)) == 1 << 20
    spark.conf.unset(name)


def test_no_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_other_columns_are_no_trouble(spark, clashing, tmp_path):
    clashing.where(F.col("doc_id") < 60).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_the_rest_works_without_these_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "matrixframe", tmp_path / "matrixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gram' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
