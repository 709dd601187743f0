import hashlib
from array import array

import public_tokenizers
from test_exact_dedup import norm
from test_near_dedup import brute as near_classes
from tokenizers import Tokenizer

import corpus_pipeline
from bourse.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.001"


def test_rows_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted(tuple(r) for r in docs.collect())
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    data = [r for r in data if model.score(quality.np.array([quality.features(r[1])]))[0] >= 0.5]
    best = {}
    for r in data:
        if norm(r[1]) not in best or (-len(r[1]), r[0]) < (-len(best[norm(r[1])][1]), best[norm(r[1])][0]):
            best[norm(r[1])] = r
    data = sorted(best.values())
    data = [r for i, (r, c) in enumerate(zip(data, near_classes(data), strict=True)) if i == c]
    copies = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(data, docs.schema), share=(1, 1), epochs=3).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in data:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want += [(r[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest(), ids)] * copies[r[0]]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_stages_keep_columns_and_take_effect(spark):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet").limit(80), None
    docs = docs.unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).count() == len({norm(r.text) for r in docs.collect()})


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_ids_give_the_texts_back(spark):
    got = corpus_pipeline.run(spark, SF)
    back = bpe.decode(got, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert back and all(texts[r.doc_id] == r.text for r in back)
