"""The corpus pipeline, stage by stage, against plain recomputation of each stage's decision."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framesift.llm import host_rules
from framesift.llm.common import table
from tests.llm.test_text import brute, check_packed


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, found = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        docs.count()
        found.append(docs)
    return sf, found


def test_stages(spark, stages):
    sf, (good, ruled, single, packed) = stages
    columns = table(spark, sf, "documents").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "best_fit_packing"]
    assert good.columns == ruled.columns == single.columns == columns
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * len(labels)

    base = {r.doc_id for r in good.collect() if (s := host_rules.text_statistics(r.text or ""))[0] >= 50 and 2 * s[5] <= s[0]}
    after = {r.doc_id for r in ruled.collect()}
    assert after <= base and len(after) >= 0.95 * len(base)

    rows = [(r.doc_id, r.text) for r in ruled.collect()]
    firsts = {eval(x)[2] for x in brute(rows, 5, 80)}
    assert {r.doc_id for r in single.collect()} == firsts

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lengths = []
    for r in single.collect():
        n = len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
        lengths += [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
    assert check_packed(packed.collect(), lengths) <= -(-sum(lengths) // 4096) + 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


CLASHING = ["_score", "_statistics", "_host", "_kept", "_key", "_set", "_row", "_stats", "host", "stats", "row", "_gone_id"]


def test_stages_keep_awkward_rows_and_columns(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that the operators use: each stage ends, and the first three keep all columns."""
    sf = "/root/testdata/sf0.01"
    given = table(spark, sf, "documents").limit(300)
    odd = spark.createDataFrame(
        [(None, "a text without an id " * 30, None, None, None), (10**6, None, "en", None, None), (10**6 + 1, "", None, "h", 0), (10**6 + 2, "lorem ipsum dolor sit amet " * 20_000, "en", "h", None)], given.schema
    )
    docs = given.unionByName(odd).unionByName(odd).withColumns({c: F.lit(c) for c in CLASHING})
    docs = docs.withColumn("_KEPT2", F.lit(1)).persist()
    before = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns, name
        assert rows and set(rows) <= before, name
        docs, before = out, set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_empty_tables(spark):
    sf = "/root/testdata/sf0.01"
    none = table(spark, sf, "documents").where("false").withColumns({c: F.lit(c) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.collect() == [], name
        assert name == "best_fit_packing" or out.columns == none.columns
