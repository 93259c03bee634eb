"""Registered queries against SQL, and the pipeline against its own parts by brute force."""

from collections import Counter

import compare
import public_tokenizers
import pytest
from test_text_joins import components, contaminated, dropped
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from terraflow.llm import quality
from terraflow.llm.queries import ORACLES, QUERIES

SF = f"{compare.TESTDATA}/sf0.001"


def test_all_are_there():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), compare.duck(SF), ORACLES[name]) == ""


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against brute force on the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns, name
            after = Counter((r.doc_id, r.text) for r in out.collect())
        if k == 0:
            kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
            assert after == Counter(x for x in before if x[0] in kept) and 0.5 * len(before) < len(kept) < len(before)
        if k == 1:
            assert after == Counter({(i, t): n for (i, t, _), n in dropped(before).items()})
        if k == 2:
            assert {i for i, _ in after} == {c[2] for c in components(before)}
        if k == 3:
            dirty = {r[0] for r in contaminated(before, bench) if r[5]}
            assert dirty and after == Counter(x for x in before if x[0] not in dirty)
        if k == 4:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in before}
            assert {r[0]: r[1] for r in out.groupBy("doc_id").sum("length").collect()} == want
            assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
        docs = out
