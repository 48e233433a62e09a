"""The pipeline against brute force on the smallest tables, and how the package is registered."""

import struct

import pytest
from pyspark.sql import functions as F
from llm.test_corpus_operators import brute_components, sets_of
from llm.test_text_operators import plain_base

import __spark_entry__ as entry
import corpus_pipeline
from fleetlake.llm import bpe, catalog, decontaminate, quality, secrets
from fleetlake.llm.common import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """(name, input, output) of every stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = session(spark).read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, staged):
    assert [n for n, _, _ in staged] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns

    _, before, after = staged[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.score(before, quality.learn(before, labels)).collect()}
    assert set(texts_of(after)) == {k for k, p in scored.items() if p}
    wrong = [r["doc_id"] for r in labels.collect() if r["doc_id"] in scored and scored[r["doc_id"]] != r["quality"]]
    assert len(wrong) <= 0.03 * labels.count()

    _, before, after = staged[1]
    components = brute_components(sets_of(texts_of(before).items(), 5))
    assert set(texts_of(after)) == {k for k, c in components.items() if k == c}

    _, before, after = staged[2]
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts_of(after)) == {k for k, t in texts_of(before).items() if not any(i in decontaminate.plain(t) for i in items)}

    _, before, after = staged[3]
    old, new = texts_of(before), texts_of(after)
    assert old.keys() == new.keys()
    for k in old:
        assert not plain_base(new[k]) and (new[k] == old[k]) == (not secrets.Scanner().spans(old[k]))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    tokenizers = pytest.importorskip("tokenizers")
    library, texts = tokenizers.Tokenizer.from_file(bpe.TOKENIZER), texts_of(staged[4][1])
    for r in staged[4][2].collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], bytes(r["ids"])) == (len(ids), struct.pack(f"<{len(ids)}I", *ids))


def test_run_equals_the_stages(spark, staged):
    def rows(df):
        return sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in df.collect())

    assert rows(corpus_pipeline.run(spark, SF)) == rows(staged[-1][2])


def test_registered():
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_on_odd_rows(spark, request, tmp_path, rows):
    """Null, empty, very long, repeated and keyless rows, clashing columns and an empty table pass all stages; each stage keeps the columns and changes no other row."""
    docs = request.getfixturevalue(rows).withColumn("n_chars", F.length("text").cast("long"))
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == before
        kept.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "secrets":
            assert after.exceptAll(docs).count() == 0
        docs = after
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(ids.columns)
    assert all((r["n_tokens"] == 0) == (len(r["ids"]) == 0) for r in ids.collect())
