import re

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from phrasemill.operators import embed
from phrasemill.operators.embed import ConcatVectors, SumVectors, Words, concat_embedding, sum_embedding
from phrasemill.operators.lookup import attach_vectors, known_words, token_stream, unknown_words
from phrasemill.plans import score, tables
from phrasemill.operators.similar import most_similar, neighbour_pairs, pair_similarity, typed_pairs
from phrasemill.operators.words import coverage
from phrasemill.sources.vectors import parse_vector_lines, read_text_vectors, vector_lines

VECTORS = {"a": [1.0, 0.5], "b": [-2.0, 0.25], "c": [0.0, 4.0]}
TEXTS = {1: "a b b x".split(), 2: ["x", "y"], 3: ["c"] * 40, 4: ["x", "a", "x", "c"]}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "word string, vec array<float>").cache()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "row_id long, words array<string>")


def summed(words):
    found = [VECTORS[w] for w in words if w in VECTORS]
    return [sum(v[i] for v in found) for i in range(2)]


def joined(words, most):
    flat = [x for w in words if w in VECTORS for x in VECTORS[w]][: 2 * most]
    return flat + [0.0] * (2 * most - len(flat))


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_sum(spark, texts, vectors, budget):
    got = {r.row_id: r.features for r in sum_embedding(texts, vectors, ["row_id"], budget=budget).collect()}
    assert got == {i: summed(w) for i, w in TEXTS.items()}


@pytest.mark.parametrize("budget", [1 << 20, 0])
@pytest.mark.parametrize("most", [2, 30])
def test_concat(spark, texts, vectors, budget, most):
    got = {r.row_id: r.features
           for r in concat_embedding(texts, vectors, ["row_id"], max_words=most, budget=budget).collect()}
    assert got == {i: joined(w, most) for i, w in TEXTS.items()}


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_concat_long_texts(spark, vectors, monkeypatch, budget):
    """Known words far behind the beginning count, also of rows that share a key or have none; other texts are not read whole."""
    rows = [(1, ["x"] * 50 + ["a", "b"]), (2, ["c"] * 500), (3, ["x"] * 9 + ["a"]), (3, ["b"] + ["x"] * 30 + ["c"]), (None, ["x"] * 40 + ["b"]), (4, ["x"] * 99)]
    df = spark.createDataFrame(rows, "row_id long, words array<string>")
    read = []
    monkeypatch.setattr(embed, "token_stream", lambda texts, keep: read.append(token_stream(texts, keep)) or read[-1])
    got = {r.row_id: r.features for r in concat_embedding(df, vectors, ["row_id"], max_words=2, budget=budget).collect()}
    assert got == {1: joined(["a", "b"], 2), 2: joined(["c", "c"], 2), 3: joined(["b", "a"], 2), None: joined(["b"], 2), 4: [0.0] * 4}
    assert read[0].count() <= 8 * len(rows) and all(r.where("row_id = 2").count() <= 8 for r in read)


def test_lookup_keeps_every_token_both_ways(spark, vectors):
    # "a" holds a third of all tokens: it takes the way for common words when nothing fits.
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(
        F.col("id") % 3 == 0, F.array(F.lit("a"))).otherwise(
        F.array(F.concat(F.lit("w"), F.col("id").cast("string")))).alias("words"))
    tokens = token_stream(rows, ["row_id"])
    for how in ("left", "inner"):
        small = attach_vectors(tokens, vectors, how).select("row_id", "word", "vec")
        large = attach_vectors(tokens, vectors, how, budget=0).select("row_id", "word", "vec")
        assert small.count() == large.count() == (3000 if how == "left" else 1000)
        assert small.exceptAll(large).isEmpty()


def test_pipeline_stages(spark, vectors):
    df = spark.createDataFrame([(1, "A b, #b x"), (2, "x"), (3, "")], "row_id long, text string")
    model = Pipeline(stages=[Words(), SumVectors(vectors)]).fit(df)
    got = {r.row_id: r.v for r in model.transform(df).select("row_id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: summed("a b b".split()), 2: [0.0, 0.0]}
    wide = Pipeline(stages=[Words(), ConcatVectors(vectors, maxWords=2)]).fit(df).transform(df)
    got = {r.row_id: r.v for r in wide.select("row_id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: joined("a b b".split(), 2), 2: [0.0] * 4}


def test_vector_lines(spark, vectors, tmp_path):
    lines = vector_lines(vectors.withColumn("line_no", F.lit(1)))
    again = spark.createDataFrame([("a 9 9.5", 2), ("d 1e-3 -2", 3)], "value string, line_no int")
    parsed = {r.word: r.vec for r in parse_vector_lines(lines.select("value", "line_no").union(again), "line_no").collect()}
    assert parsed["a"] == [9.0, 9.5] and parsed["b"] == VECTORS["b"] and len(parsed) == 4
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\na 5 6\n")
    read = {r.word: r.vec for r in read_text_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert read == {"a": [5.0, 6.0], "b": [3.0, 4.0]}


def test_coverage(spark, vectors):
    words = spark.createDataFrame([("a",), ("x",), ("b",)], "word string")
    assert tuple(coverage(words, vectors).first()) == (3, 2, 66.67)
    assert sorted(r.word for r in known_words(words, vectors).collect()) == ["a", "b"]
    assert [r.word for r in unknown_words(words, vectors).collect()] == ["x"]


def test_similarity(spark, vectors):
    top = most_similar(vectors, "a", 1).first()
    assert top.word == "c" and top.similarity == pytest.approx(44.7214)
    with pytest.raises(KeyError):
        most_similar(vectors, "nothing")
    got = {(r.w1, r.w2): r.similarity for r in pair_similarity(typed_pairs(spark, ["b", "a", "x", "a"]), vectors).collect()}
    assert list(got) == [("a", "b")] and got["a", "b"] == pytest.approx(-0.83205)
    texts = spark.createDataFrame([(["b", "a", "a", "b", "c"],), (["z"],)], "words array<string>")
    assert sorted(tuple(r) for r in neighbour_pairs(texts).collect()) == [("a", "b"), ("b", "c")]


def test_text_points_tokenise_once(spark, monkeypatch, tmp_path):
    """Vocabulary and text vectors come from the same stored word lists."""
    spark.createDataFrame([(1, "b a a", "de"), (2, "a c", "en"), (None, "z", "fr"), (4, None, "es")], "doc_id long, text string, lang string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    calls = []
    for place in (tables, score):
        if hasattr(place, "tokenised"):
            monkeypatch.setattr(place, "tokenised", lambda *a, held=place.tokenised: calls.append(1) or held(*a))
    points, _ = tables.text_points(spark, str(tmp_path))
    assert sorted((str(r.row_id), r.label, r.vec) for r in points.collect()) == [("1", 0, [2.5, 4.0]), ("2", 1, [1.0, 2.0]), ("None", 3, [0.0, 0.0])]
    assert len(calls) == 1


def test_pair_similarity_runs_no_code_too_large_to_compile(spark, capsys):
    """The JVM interprets methods beyond 8,000 bytes; a sum of products written out for every pair was one."""
    rng = np.random.default_rng(4)
    vecs = {w: [float(x) for x in rng.normal(size=64)] for w in "abc"}
    vectors = spark.createDataFrame([*vecs.items(), ("d", [1.0] * 63 + [None]), ("e", None)], "word string, vec array<float>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = pair_similarity(typed_pairs(spark, list("abcde")), vectors)
        out.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
    got = {r.w1 + r.w2: r.similarity for r in out.collect()}
    assert len(got) == 10 and all(got[p] is None for p in got if set(p) & set("de"))
    for p in ("ab", "ac", "bc"):
        x, y = (np.array(vecs[w], dtype=np.float32).astype(float) for w in p)
        assert got[p] == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=2e-6)
