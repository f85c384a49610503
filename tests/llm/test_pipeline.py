import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.common_rows import DOCS, docs
from tests.llm.test_dedup import brute_components
from tests.llm.test_filters import brute_hits
from tidewell.llm import mixing, quality

P = pytest.importorskip("public_tokenizers")

def test_stages_one_by_one(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    bench = [(1, " ".join(f"w{i}" for i in range(5)))]
    df = docs(spark)
    texts = sorted(r.text for r in df.collect() if r.text and 300 < len(r.text) < 1000)
    bench.append((2, texts[0][:200]))
    spark.createDataFrame(bench, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    df.write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/out{i}")
        after = spark.read.parquet(f"{folder}/out{i}")
        if i < 4:
            assert after.columns == df.columns, name
            got = sorted(r.doc_id for r in after.collect())
        if i == 0:
            assert got == sorted(r.doc_id for r in quality.score_quality(now).where("kept").collect())
        if i == 1:
            assert got == sorted(d for d, (_, _, k) in brute_components(before).items() if k)
        if i == 2:
            assert got == sorted(x[0] for x in brute_hits(before, [(str(a), b) for a, b in bench]) if not x[5])
        if i == 3:
            assert got == sorted(r.doc_id for r in mixing.mix(now).collect())
        if i == 4:
            assert after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            ids = [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in before]
            rows = after.orderBy("start").collect()
            assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
            assert [r.doc_id for r in rows] == sorted(d for d, _ in ids) and [r.start for r in rows] == [
                sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))
            ]
        now = after
    assert corpus_pipeline.run(spark, folder).count() == now.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
