"""The registered queries of the subpackage and the pipeline on the smallest tables."""

import duckdb
import pytest

from trovelight.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).collect()
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        rel = con.sql(queries.ORACLES[name])
        cols = [d[0] for d in rel.description]
        assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got)


ODD = [
    (1, "the cat sat on the mat and it was a very good mat for a cat to sit on all day long", "en", "s", 1, "x"), (1, "the cat sat on the mat and it was a very good mat for a cat to sit on all day long", "en", "s", 1, "x"),
    (2, None, None, None, None, None), (3, "", "en", None, 0, "x"), (4, " \n ", "fr", "s", 3, "x"), (5, "1234 56 !!", None, "s2", 1, "x"), (None, "a row without an id that is kept as it is by all of the stages", "en", "s", 1, "x"),
    (6, " ".join(f"some{i % 900} word{i % 700}" for i in range(30_000)), "en", "s", 1, "x"), (7, "the dog ran over the hill and then it came back home for its dinner in the evening", "en", "s3", 1, "x"),
    (7, "the cat sat on the mat and it was a very good mat for a cat to sit on all day long too", "en", "s3", 1, "x"),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_stages_on_odd_rows(spark, sf_dir, rows):
    import corpus_pipeline as P

    from trovelight.llm import common

    more = "score double, rejected boolean, lang_pred string, row int, t int, _source string, _order double, __text string, item_id long"
    docs = spark.createDataFrame([(*r, 0.5, True, "z", 1, 2, "q", 0.1, "u", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, host string, " + more)
    kept = {"language_id": None, "toxicity": None, "near_duplicates": None, "mixing": None}
    for name, stage in P.STAGES:
        out = common.materialize(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = sorted((r.doc_id or 0, (r.text or "")[:11]) for r in out.collect())
            docs = out
    if not rows:
        assert out.count() == 0 and not any(kept.values())
        return
    # Trained on next to nothing, the first stage lets all texts with letters pass.
    with_letters = sorted((r[0] or 0, r[1][:11]) for r in ODD if r[1] and any(c.isalpha() for c in r[1]))
    assert kept["language_id"] == kept["toxicity"] == with_letters
    assert kept["near_duplicates"] == [(0, "a row witho"), (1, "the cat sat"), (6, "some0 word0"), (7, "the dog ran")]
    assert set(kept["mixing"]) == set(kept["near_duplicates"])
    assert {r.doc_id for r in out.collect()} == {None, 1, 6, 7} and out.filter("doc_id = 6").agg({"length": "sum"}).first()[0] > 60_000


def test_pipeline_stages_against_their_operators(spark, sf_dir):
    import corpus_pipeline as P

    from trovelight.llm import common, jaccard, toxicity

    docs = common.table(spark, sf_dir, "documents")
    for name, stage in P.STAGES:
        out = common.materialize(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            labels = common.table(spark, sf_dir, "labels").filter(common.doc_remainder("doc_id", 3) != 1)
            low = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).filter("score < 0.7").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == low
        if name == "near_duplicates":
            want = sorted({r.class_id for r in jaccard.similarity_classes(docs).collect()})
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want
        if name == "mixing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert {r.doc_id for r in docs.select("doc_id").collect()} and docs.agg({"offset": "max"}).first()[0] < 4096
