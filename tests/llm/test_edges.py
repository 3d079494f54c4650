"""Awkward tables for every operator: empty ones, nulls in any column, repeated rows, other columns of clashing names, very long texts."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from quern.llm import jaccard, kdmeans, language, licences, lines, lm, mixing, pieces, quality, queries, repeats, spelling  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(1, "All rights reserved. Licensed under the Apache License, Version 2.0.\nline two of it", "en", "s"), (1, "All rights reserved. Licensed under the Apache License, Version 2.0.\nline two of it", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no number at all", "de", None), (None, None, None, None), (4, "word " * 3000 + "ß" * 50, "de", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use for results and inside.
CLASHING = ("n_words", "labels", "score", "kept", "gone", "size", "copy", "key", "h", "n", "word", "form", "line", "run", "id", "text_hash", "nth", "chunk", "component_id", "place")


def judged(docs):
    return quality.judge(docs, quality.DEFAULT)


OPERATORS = {
    "licences": licences.scan, "pieces": lambda d: pieces.encode(d, MODEL), "repeats": repeats.dedup, "lines": lambda d: lines.dedup(d, short=True), "mixing": mixing.taken, "lm": lm.score, "quality": judged,
    "jaccard": lambda d: jaccard.join(d, n=4, num=85, den=100), "language": lambda d: language.identify(d, language.fit(d)), "spelling": spelling.variants,
}
EACH_ROW = set(OPERATORS) - {"spelling"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_awkward_tables(spark, name):
    run = OPERATORS[name]
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = run(docs)
    if name in EACH_ROW:
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.select("doc_id").collect()) == [-1, -1, 1, 1, 2, 3, 4]
    clashing = docs
    for k, c in enumerate(CLASHING):
        clashing = clashing.withColumn(c, F.lit(k))
    narrow = [c for c in got.columns if c not in CLASHING] or got.columns
    rows = lambda df: sorted(map(str, df.select(*narrow).collect()))
    assert rows(run(clashing)) == rows(got)


def test_all_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA + ", n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_very_long_text_in_kmeans_and_language(spark):
    text = "der die das und " * 200_000
    model = language.Model(["de"], language.np.ones(language.FEATURES), language.np.zeros((language.FEATURES + 1, 1)), 1.0)
    assert model(text) == ("de", 1.0)
    vectors = spark.createDataFrame([(i, [float(i)] * 64, "x") for i in range(20)], "vec_id long, embedding array<double>, cluster string")
    assert kdmeans.cluster(vectors).count() == 20
