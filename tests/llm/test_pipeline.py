"""The pipeline's rows against a brute-force version of all its stages."""

import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from test_methods import RANKS, brute_components, brute_fingerprint

import corpus_pipeline
from muster.llm import bpe, quality_rules
from muster.llm.common import table


def brute_force(spark, folder):
    t = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    docs = [(None if r["doc_id"] is None else int(r["doc_id"]), r["text"] or "") for r in t]
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    kept = {r.doc_id for r in judged.filter("kept").collect()}
    low = lambda k: -1 if k is None else k
    last = {}
    for k, text in docs:
        if k in kept and (text not in last or low(k) >= low(last[text])):
            last[text] = k
    text = {k: x for x, k in last.items()}
    same = brute_components({low(k): brute_fingerprint(text[k]) for k in sorted(text, key=low)})
    coder = tiktoken.Encoding("all", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bpe.tokenizer(RANKS, P.PATTERN).bytes_of)}, special_tokens={})
    want = {}
    for k, x in text.items():
        if same[low(k)] == low(k):
            ids = coder.encode_ordinary(x)
            want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    return want


def result(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_pipeline(spark, small):
    got = result(spark, small)
    assert got == brute_force(spark, small) and len(got) > 50


@pytest.fixture(scope="module")
def odd_tables(spark, odd, labels, tmp_path_factory):
    """The odd rows, and texts long enough for the rules: copies, near copies, repeated rows, a null identifier and source."""
    folder = str(tmp_path_factory.mktemp("odd"))
    words = [f"word{i * 7 % 101} and{i}" for i in range(80)]
    long = [(100, " ".join(words)), (101, " ".join(words)), (102, " ".join([*words[:-1], "last one"])), (103, " ".join(words[::-1])), (103, " ".join(words[::-1])), (104, "Grüße 😀 " + " ".join(words[20:]) * 30)]
    rows = spark.createDataFrame([(i, t, None, None if i == 103 else "src1", len(t), "x", True, "y") for i, t in long], odd.schema)
    odd.unionByName(rows).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_with_odd_rows(spark, odd_tables):
    got = result(spark, odd_tables)
    assert got == brute_force(spark, odd_tables) and set(got) == {101, 103}


def test_pipeline_with_nothing(spark, odd, labels, tmp_path):
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_return_the_columns_of_documents(spark, odd_tables):
    docs = table(spark, odd_tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_tables)
        assert docs.columns == table(spark, odd_tables, "documents").columns
