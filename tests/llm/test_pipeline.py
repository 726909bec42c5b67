import corpus_pipeline as pipeline
from cliploom.llm import pii
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near
from tests.llm.test_packing import check as check_packing
from tests.llm.test_pii import plain as plain_spans


def test_each_stage_on_its_own_input(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 400")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    given = rows(docs)
    clean = pipeline.without_toxic(spark, docs, sf_dir)
    kept = rows(clean)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert clean.columns == docs.columns and all(kept[i] == given[i] for i in kept)
    assert sum(i not in kept for i in given if labels.get(i) == 0) < 0.15 * len(given)
    network = pipeline.fitted(spark, docs, sf_dir)
    assert set(kept) == {r.doc_id for r in pipeline.toxicity.score(docs, network).collect() if r.score < 0.7}

    lines = rows(pipeline.without_repeated_lines(spark, docs, sf_dir))
    want = brute_lines([(i, r.text) for i, r in given.items()])
    assert {i: r.text for i, r in lines.items()} == {i: w[3] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())

    near = rows(pipeline.without_near_duplicates(spark, docs, sf_dir))
    want = brute_near({i: r.text for i, r in given.items()}, 5)
    assert {i for i, w in want.items() if w[2]} == set(near)

    hidden = rows(pipeline.without_personal_data(spark, docs, sf_dir))
    assert set(hidden) == set(given)
    for i, r in hidden.items():
        assert not pii.base_spans(r.text) and (r.text == given[i].text) == (not plain_spans(given[i].text))

    check_packing(pipeline.packed(spark, docs, sf_dir).collect(), {i: r.text for i, r in given.items()})


def test_run_keeps_documents_that_no_stage_rejects(spark, tmp_path):
    labels = [(i, 1, int(i % 4 == 0)) for i in range(40)]
    docs = [(i, "you utter moron leave now" if i % 4 == 0 else f"meeting {i} {i * 7} of the council {i * 3} was held", "en", "s", 1) for i in range(40)]
    docs += [(50, docs[1][1], "en", "s", 1), (51, None, None, None, None), (None, "write to a.b@c.de", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(ids, key=str) == sorted([i for i in range(40) if i % 4] + [50, 51, None], key=str)
