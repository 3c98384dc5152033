"""Every query and stage over odd tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import pytest
from conftest import same

import corpus_pipeline
from rxloom.llm.queries import ORACLE_SQL, QUERIES

LONG = " ".join(f"word{i % 977} password=abc{i}defgh" if i % 500 == 0 else f"w{i}" for i in range(60_000))
#: One unbroken run of key-like characters, and one of hex digits and separators.
RUN, HEXES = "".join(f"{i * 7919 % 9973}Kz" for i in range(3000)), "-".join(["0123456789abcdef" * 2] * 300)
DOCUMENTS = [(1, "", "en", "src0", 0), (2, None, None, None, None), (3, LONG, "en", "src1", len(LONG)), (4, "same text here", "en", "src1", 14), (4, "same text here", "en", "src1", 14), (5, "same text here", "de", "x", 14), (None, "same text here", "en", "src2", 14), (6, "ÄÖ ßß éé \u0000 x", "de", "src3", 10), (7, " \t\n", "en", "src1", 3), (8, RUN, "en", "src0", len(RUN)), (9, HEXES, "en", "src0", len(HEXES))]
CLASH = "id long, t string, row string, fp long, h long, k long, d long, l string, slot string, block long, start long, component string, items string, score double, text_ string, mix_block string, spans string, base string"


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(request.param))
    full = request.param == "odd"
    extra = [None] * len(CLASH.split(", "))

    def put(name, rows, schema, more=True):
        df = spark.createDataFrame([tuple(r) + tuple(extra if more else []) for r in rows] if full else [], schema + (f", {CLASH}" if more else ""))
        df.repartition(2).write.parquet(f"{folder}/{name}.parquet")

    put("documents", DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(1, 0, 0), (3, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 0), (9, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int", False)
    put("benchmark", [(1, "what is the answer to this one? it is forty two."), (2, None), (3, ""), (None, "x y z"), (1, "what is the answer to this one? it is forty two.")], "item_id long, text string", False)
    put("pages", [(1, "http://A.net/x", ""), (2, None, None), (None, "http://b.org/fr/", ""), (1, "http://A.net/x", ""), (4, "http://" + "a" * 50_000 + ".com/de/1", ""), (5, "://", ""), (6, "", "")], "page_id long, url string, html string")
    put("embeddings", [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, None), (None, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    put("conversations", [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "")], "conv_id long, turn long, role string, text string", False)
    return folder, len(DOCUMENTS) if full else 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_odd_tables(spark, tables, name):
    folder, n = tables
    rows = QUERIES[name](spark, folder).collect()
    table = {"op7": "pages", "op9": "embeddings", "op11": "pages"}.get(name.split("_")[0], "documents")
    if not name.startswith("op4_"):
        assert len(rows) == spark.read.parquet(f"{folder}/{table}.parquet").count()
    if name in ORACLE_SQL:
        same(QUERIES[name](spark, folder), ORACLE_SQL[name], folder)


def test_pipeline_on_odd_tables(spark, tables):
    folder, n = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() <= n
        assert len(set(out.columns)) == len(out.columns) and set(out.columns) >= set(docs.columns)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    corpus_pipeline.run(spark, folder).collect()


def test_pipeline_stages_on_their_own(spark):
    """Every stage keeps what it should of the whole table, and run() equals the stages one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
    assert docs.count() >= 100
