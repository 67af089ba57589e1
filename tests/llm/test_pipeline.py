"""The stages one after the other, against the operators on the same rows."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from configsieve.llm import rules
from configsieve.llm.oracles import ORACLES
from configsieve.llm.queries import QUERIES
from configsieve.llm.storage import settled, table
from tests.llm.test_mixing import words
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check_packed
from tests.oracle_check import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settled(stage(spark, out[-1], SF_DIR), "test-stage"))
    return out


def texts(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_all_but_the_last_return_documents(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_filters_only_drop(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert not texts(after) - texts(before)


def test_rules_and_copies(stages):
    toxic_free, ruled, single = map(texts, stages[1:4])
    assert ruled == Counter({k: n for k, n in toxic_free.items() if rules.rejected_by(rules.Text(k[1]), list(rules.RULES.items())) is None})
    assert {i for i, _ in single} == {least for _, _, least in brute(list(ruled))}


def test_mixture_and_packing(stages):
    before, mixed = stages[3].collect(), stages[4].collect()
    assert sum(words(r.text) for r in mixed) == pytest.approx(1.5 * sum(words(r.text) for r in before), abs=20)
    assert all(r.n_chars == len(r.text) for r in mixed)
    check_packed(stages[5].collect(), [(r.doc_id, r.text) for r in mixed])


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == stages[5].columns
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, rows.select(*keys).collect())) == Counter(map(tuple, stages[5].select(*keys).collect()))


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert difference(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) is None


def stored(frame, folder):
    """A folder with this table of documents and the small labels."""
    frame.write.parquet(f"{folder}/documents.parquet")
    frame.sparkSession.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_odd_documents(spark, tmp_path, odd_documents):
    """Null ids and texts, repeated rows, long texts and extra columns go through all stages, with documents that stay."""
    clean = table(spark, SF_DIR, "documents").where("doc_id >= 100")
    folder = stored(odd_documents.unionByName(clean, allowMissingColumns=True), tmp_path)
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settled(stage(spark, docs, folder), "test-odd")
        assert out.columns == odd_documents.columns, name
        if name != "mixing sources to target weights":
            assert not texts(out) - texts(docs), name
        docs = out
    assert docs.count() > 50
    assert corpus_pipeline.run(spark, folder).count() == corpus_pipeline.pack(spark, docs, folder).count()


def test_stages_take_odd_documents_alone(spark, odd_documents):
    """Each stage by itself, on everything the stages before would have dropped."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_documents, SF_DIR)
        assert out.columns == odd_documents.columns, name
        left = [r.text for r in out.collect()]
        if name == "quality rules":  # each is too short, repeats itself or has words full of digits
            assert len(left) == sum(rules.rejected_by(rules.Text(d.text), list(rules.RULES.items())) is None for d in odd_documents.collect())
        else:
            assert left, name
    check_packed(corpus_pipeline.pack(spark, odd_documents, SF_DIR).collect(), [(d.doc_id, d.text) for d in odd_documents.collect()])


def test_no_documents(spark, tmp_path, no_documents):
    folder = stored(no_documents, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table(spark, folder, "documents"), folder)
        assert (out.columns, out.count()) == (no_documents.columns, 0), name
    assert corpus_pipeline.run(spark, folder).count() == 0
