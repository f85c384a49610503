"""Every query on tables with clashing extra columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.common_rows import docs
from tidewell.llm import queries

pytest.importorskip("public_tokenizers")

#: Names that operators give to columns of their own.
CLASHES = {
    "documents": """n_shingles component_id component kept k1 k2 sig copies node place _m _n _a n_words q_n_words word_chars n_symbols base_failed metric bucket n t_lang limit_symbol_share mix_source mix_copy mix_copies mix_rate mix_key
        rate pieces cdf mix_u size weight held_out lang_pred score u parts _l shard ids turn start n_tokens hits items unnamed block text_key anchor run runs own starts copied removed spans scores""".split(),
    "pages": "host path rule verdict score payload payload_digest payload_bytes record_id record_type refers_to key first_id again_id word bits chunk_no last data n".split(),
    "benchmark": "block size names hits item w n".split(),
}
NAMES = sorted({**queries.QUERIES, "pipeline": corpus_pipeline.run})


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    d = docs(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 70 and length(text) < 3000 or text is null")
    some = [r.text for r in d.where("length(text) > 300").orderBy("doc_id").limit(2).collect()]
    tables = {
        "documents": d,
        "benchmark": spark.createDataFrame([(1, some[0][:200]), (None, some[1][20:220]), (3, None), (4, "")], "item_id BIGINT, text STRING"),
        "pages": spark.createDataFrame([(i % 25, f"https://{'www.' * (i % 2)}name{i}.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es')[i % 3]}/{i}" if i % 7 else None, "<p>" + "text " * (i % 9 * 8) if i % 6 else None) for i in range(40)], "page_id BIGINT, url STRING, html STRING"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{root}/plain/{name}.parquet")
        df.select("*", *(F.lit("clash").alias(c) for c in CLASHES[name] if c not in df.columns)).write.parquet(f"{root}/clash/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root


def _run(name):
    return corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_change_nothing(spark, folders, name):
    a, b = (_run(name)(spark, f"{folders}/{kind}") for kind in ("plain", "clash"))
    assert a.columns == b.columns
    rows = sorted(map(tuple, a.collect()), key=repr)
    assert rows and rows == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, folders, name):
    assert _run(name)(spark, f"{folders}/empty").count() == 0
