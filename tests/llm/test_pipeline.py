"""The pipeline against its stages by brute force, on the smallest table."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from .test_text_ops import near_brute

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 150")
    cols = docs.columns
    at = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(pipeline.STAGES) - 1 or docs.columns == cols
        at.append(docs)
    first = [(r["doc_id"], r["text"]) for r in at[0].collect()]
    assert len(first) >= 145
    assert sorted(r["doc_id"] for r in at[1].collect()) == sorted(d for d, _, _, kept in near_brute(first) if kept)
    assert at[2].count() <= at[1].count() and at[2].filter(F.length("text") != F.col("n_chars")).count() <= at[1].filter(F.length("text") != F.col("n_chars")).count()
    copies = at[3].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 2
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in at[3].collect()}
    rows = at[4].collect()
    assert len(rows) == at[3].count()
    for r in rows[:40]:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
