import pytest
from test_suffix import brute
from util import MID, have_tables

import corpus_pipeline
from ledgerloom.llm import mixing, near_dedup, registry, sentencepiece_fst, suffix_dedup, toxicity


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    columns, out = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, MID).write.parquet(str(tmp_path / name))
        out[name] = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out[name].columns == columns
        docs = out[name]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start = spark.read.parquet(f"{MID}/documents.parquet")
    m = toxicity.fit(start, spark.read.parquet(f"{MID}/labels.parquet"))
    assert ids(out["toxicity"]) == {r.doc_id for r in toxicity.score(start, m).collect() if not r.toxic}
    g = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(out["toxicity"]).collect()}
    assert ids(out["near_dedup"]) == {i for i in ids(out["toxicity"]) if g.get(i, i) == i}
    assert brute([(r.doc_id, r.text) for r in out["suffix_dedup"].collect()], suffix_dedup.MIN_WORDS) == set()
    assert len(ids(out["near_dedup"]) - ids(out["suffix_dedup"])) <= 0.02 * len(ids(out["near_dedup"]))
    assert ids(out["mixing"]) == ids(mixing.mix(out["suffix_dedup"]))
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(out["sentencepiece"]).collect()}
    assert back == {r.doc_id: r.text for r in out["mixing"].collect()}
    assert ids(corpus_pipeline.run(spark, MID)) == ids(out["sentencepiece"])


def test_registry():
    assert [k.split("_")[0] for k in registry.queries() if k.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "sentencepiece"]


def test_stages_of_odd_and_of_no_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, names that clash, then nothing at all."""
    from util import empty, messy

    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, docs in enumerate((messy(spark), empty(spark))):
        columns, last = docs.columns, len(corpus_pipeline.STAGES) - 1
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == last or out.columns == columns
            out.write.parquet(str(tmp_path / f"{k}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{i}"))
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            if k == 0 and name in ("toxicity", "near_dedup", "suffix_dedup"):
                assert {None, 1, 3, 4, 5, 9} <= ids
        assert (docs.count() == 0) == (k == 1)


def test_last_stage_decodes_what_it_encodes(spark, tmp_path):
    """As op10 does: every text's ids are decoded and compared, only a null text has nothing to compare."""
    from util import empty, messy

    for docs in (messy(spark), empty(spark)):
        got = corpus_pipeline.encode(spark, docs, str(tmp_path))
        want = sentencepiece_fst.encode(docs)
        assert got.schema == want.schema
        rows = lambda df: sorted((str(r.doc_id), str(r.ids), str(r.n_tokens), str(r.decodes)) for r in df.collect())
        assert rows(got) == rows(want)
        assert all(r.decodes is (None if r.ids is None else True) for r in got.collect())
