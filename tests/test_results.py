import pytest
from pyspark.sql import functions as F

from phrasemill.functions.params import linear_range, log_range, params_text
from phrasemill.functions.vectors import normalise
from phrasemill.operators.evaluate import accuracy, cv_macro, cv_micro, misclassified
from phrasemill.operators.select import expand_training_set, select_labelled
from phrasemill.operators.words import category_profile, dominant, mixed_colour, top_words
from phrasemill.plans import analysis
from phrasemill.plans.classifiers import CLASSIFIERS, combinations
from phrasemill.plans.score import is_confident
from phrasemill.sources import results as r
from phrasemill.sources import texts as t

HEAD = "GloveEmbedding;glove.txt,200;SumEmbedding;"
LINES = [
    (0, "Mlp", HEAD + "{'alpha': 0.0001, 'activation': 'logistic', 'hidden_layer_sizes': (100, 50)};90.08"),
    (1, "Mlp", HEAD + "{'alpha': 0.0001, 'activation': 'relu', 'hidden_layer_sizes': (100, 50)};90.98"),
    (2, "Mlp", HEAD + "{'alpha': 0.001, 'activation': 'logistic', 'hidden_layer_sizes': (100, 50)};90.98"),
    (3, "Svm", HEAD + "{'C': 1000, 'gamma': 1e-07};75.82"),
    (4, "Svm", HEAD + "{'C': 1000, 'gamma': 1e-05};90.25"),
    (5, "Svm", HEAD.replace("Sum", "Concat") + "{'C': 10000, 'gamma': 1e-05};60.25"),
    (6, "Forest", HEAD + "{'max_features': 'auto', 'criterion': 'gini', 'max_depth': None};85.49"),
    (7, "Forest", HEAD + "{'max_features': 'auto', 'criterion': 'gini', 'max_depth': 5};120.5"),
]
EVALUATIONS = [
    (0, "Mlp", "test", HEAD + "86.64"), (1, "Mlp", "test", HEAD + "10.00"), (2, "Mlp", "train", HEAD + "100.00"),
    (3, "Svm", "test", HEAD.replace("200", "300") + "1.00"), (4, "Svm", "test", HEAD + "87.30"),
]


@pytest.fixture(scope="module")
def results(spark):
    return r.parse_results(spark.createDataFrame(LINES, "line_no long, classifier string, value string")).cache()


@pytest.fixture(scope="module")
def evaluations(spark):
    return r.parse_evaluations(
        spark.createDataFrame(EVALUATIONS, "line_no long, classifier string, split string, value string"))


def test_parse(results):
    rows = {x.line_no: x for x in results.collect()}
    assert rows[0].params == {
        "alpha": "0.0001", "activation": "logistic", "hidden_layer_sizes": "(100, 50)",
        "Sentence Embedding": "SumEmbedding", "Word Embedding": "GloveEmbedding(glove.txt,200)"}
    assert (rows[0].word_emb_path, rows[0].dim, rows[0].cv) == ("glove.txt", 200, 90.08)
    assert rows[6].params["max_depth"] == "None"


def test_best(results, evaluations):
    best = {x.classifier: x.line_no for x in analysis.best_params(results).collect()}
    assert best == {"Mlp": 1, "Svm": 4, "Forest": 7}
    got = {x.classifier: (x.test_score, x.train_score)
           for x in analysis.best_with_evaluation(results, evaluations).collect()}
    assert got == {"Mlp": (86.64, 100.0), "Svm": (87.3, 0.0), "Forest": (0.0, 0.0)}
    two = results.where("classifier <> 'Forest'")
    assert analysis.best_overall(two, ["Svm", "Mlp"]).first().classifier == "Mlp"
    tied = two.where("line_no in (2, 4)").withColumn("cv", F.lit(50.0))
    assert analysis.best_overall(tied, ["Svm", "Mlp"]).first().classifier == "Mlp"
    assert analysis.best_overall(tied, ["Mlp", "Svm"]).first().classifier == "Svm"
    ranking = [x.classifier for x in analysis.model_ranking(results, evaluations).orderBy("place").collect()]
    assert ranking == ["Forest", "Mlp", "Svm"]


def test_profiles(results):
    summary = {x.classifier: (x.best, x.average, x.combinations) for x in analysis.grid_summary(results).collect()}
    assert summary["Mlp"] == (90.98, 90.68, 3)
    by = {(x.classifier, x.sent_emb): x.best for x in analysis.by_sentence_embedding(results).collect()}
    assert by["Svm", "ConcatEmbedding"] == 60.25
    run = {(x.classifier, x.sent_emb): x.running_max_avg for x in analysis.running_max_average(results, 2).collect()}
    assert run["Svm", "SumEmbedding"] == pytest.approx(83.04, abs=0.006)
    one = {(x.classifier, x.param_value): (x.average, x.lowest, x.highest)
           for x in analysis.param_profile(results.where("classifier = 'Mlp'"), "alpha").collect()}
    assert one["Mlp", "0.0001"] == (pytest.approx(90.53), 90.08, 90.98)
    pairs = {(x.first, x.second): (x.highest, x.capped)
             for x in analysis.param_pair_profile(results, "C", "gamma").collect()}
    assert pairs == {(1000.0, 1e-7): (75.82, 75.82), (1000.0, 1e-5): (90.25, 90.25), (10000.0, 1e-5): (60.25, 60.25)}
    assert analysis.param_pair_profile(results, "max_features", "criterion").isEmpty()
    wide = analysis.param_matrix(results, "C", "gamma", [1e-7, 1e-5]).orderBy("first").collect()
    assert [tuple(x)[2:] for x in wide] == [(75.82, 90.25), (None, 60.25)]


def test_sinks(spark, results, tmp_path):
    path = str(tmp_path / "r")
    r.append_results(results.where("classifier = 'Svm'"), path)
    r.append_results(results.where("classifier = 'Mlp'"), path)
    assert spark.read.parquet(path).count() == 6
    ev = spark.createDataFrame([("A", "test", 1.0), ("A", "train", 2.0)], "classifier string, split string, score double")
    path = str(tmp_path / "e")
    r.write_evaluations(ev, path)
    r.write_evaluations(ev.where("split = 'test'").withColumn("score", F.lit(5.0)), path)
    assert {x.split: x.score for x in spark.read.parquet(path).collect()} == {"test": 5.0, "train": 2.0}
    (tmp_path / "set_SvmAlgorithm_grid_search_results.txt").write_text("\n".join(x[2] for x in LINES[3:5]) + "\n")
    read = r.read_results(spark, str(tmp_path / "set_SvmAlgorithm_grid_search_results.txt")).orderBy("line_no").collect()
    assert [(x.classifier, x.cv) for x in read] == [("SvmAlgorithm", 75.82), ("SvmAlgorithm", 90.25)]
    (tmp_path / "set_SvmAlgorithm_train_set_evaluation.txt").write_text(HEAD + "99.51\n")
    got = r.read_evaluations(spark, str(tmp_path / "set_SvmAlgorithm_train_set_evaluation.txt"), "train").first()
    assert (got.classifier, got.split, got.score) == ("SvmAlgorithm", "train", 99.51)
    (tmp_path / "sweep.txt").write_text("1;0.2;0.43;0.08\n200;0.91;0.25;0.08\n")
    assert [tuple(x) for x in r.read_sweep(spark, str(tmp_path / "sweep.txt")).collect()][1] == (200, 0.91, 0.25, 0.08)


def test_text_files(spark, tmp_path):
    (tmp_path / "set.txt").write_text("1 Hello World 7\n0  ... \n2 #x\n")
    read = {x.label: x.words for x in t.read_labelled(spark, str(tmp_path / "set.txt")).collect()}
    assert read == {1: ["hello", "world", "seven"], 2: ["x"]}
    t.write_processed(t.read_labelled(spark, str(tmp_path / "set.txt")), str(tmp_path / "p"))
    assert {x.label: x.words for x in t.read_processed(spark, str(tmp_path / "p")).collect()} == read
    (tmp_path / "info.json").write_text('{\n"Title": "x",\n"Categories": ["B", "A"],\n"Size": 3}')
    dim = t.category_dim(t.read_descriptor(spark, str(tmp_path / "info.json"))).collect()
    assert [tuple(x) for x in dim] == [(0, "B"), (1, "A")]


def test_parameters(spark):
    one = spark.range(1)
    assert one.select(log_range(-1, 3)).first()[0] == [0.1, 1.0, 10.0, 100.0]
    assert one.select(linear_range(1, 2, 5)).first()[0] == [1.0, 1.25, 1.5, 1.75, 2.0]
    assert params_text({"b": (1, 2), "a": None}) == "{'a': None, 'b': (1, 2)}"
    assert {k: len(combinations(v.grid)) for k, v in CLASSIFIERS.items()} == {
        "SvmAlgorithm": 45, "RandomForestAlgorithm": 36, "MLPAlgorithm": 8, "NearestNeighborsAlgorithm": 180}
    first = combinations({"b": [1, 2], "a": ["x", "y"]})
    assert first == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}]


def test_scores(spark):
    p = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1)], "label int, prediction int, fold int")
    assert tuple(accuracy(p).first()) == (75.0, 3, 4)
    assert cv_micro(p).first().cv == 75.0
    assert cv_macro(p).first().cv == pytest.approx(83.333333)
    assert misclassified(p).count() == 1
    q = spark.createDataFrame([([0.1, 0.2, 0.7],), ([0.8, 0.1, 0.1],)], "probability array<double>")
    assert q.where(is_confident(0.7)).count() == 1 and q.where(is_confident(0.7, True)).count() == 2
    assert q.select(normalise(F.array(F.lit(1.0), F.lit(3.0)))).first()[0] == [0.25, 0.75]


def test_words(spark):
    texts = spark.createDataFrame([(0, ["aaa", "aaa", "b"]), (1, ["aaa", "ccc"]), (1, ["ccc"])], "label int, words array<string>")
    profile = category_profile(texts, 2, longer_than=2).withColumn("label", dominant(F.col("counts")))
    got = {x.word: (x.counts, x.total, x.label) for x in profile.collect()}
    assert got == {"aaa": ([1, 1], 2, 0), "ccc": ([0, 2], 2, 1)}
    assert [x.word for x in top_words(profile.drop("label"), 1).orderBy("word").collect()] == ["aaa", "ccc"]
    colour = spark.createDataFrame([([1, 2],)], "counts array<long>").select(*mixed_colour(F.col("counts"))).first()
    assert tuple(colour) == pytest.approx((1 / 9, 8 / 9, 0.0))


def test_selection(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_id long, text string")
    answers = spark.createDataFrame(
        [(0, "B"), (1, "1"), (2, "2"), (3, "-1"), (4, "nothing"), (5, "0")], "row_id long, answer string")
    dim = spark.createDataFrame([(0, "B"), (1, "A")], "idx int, name string")
    got = {x.row_id: x.label for x in select_labelled(texts, answers, dim).collect()}
    assert got == {0: 0, 1: 1, 5: 0}
    old = spark.createDataFrame([(9, 1, "t1"), (8, 0, "z")], "row_id long, label int, text string")
    both = expand_training_set(old, select_labelled(texts, answers, dim))
    assert sorted((x.row_id, x.text) for x in both.collect()) == [(0, "t0"), (5, "t5"), (8, "z"), (9, "t1")]


def test_best_params_holds_leading_rows_only(spark):
    """Scores and lines are found by sums of fixed size; whole rows, with maps, are not sorted."""
    rows = [("a", i, {"k": str(i)}, float(i % 7)) for i in range(40)] + [(None, 1, None, 3.0), ("b", 2, {}, 0.0), ("c", None, {}, 5.0), ("a", 6, {"k": "6"}, 6.0)]
    best = analysis.best_params(spark.createDataFrame(rows, "classifier string, line_no int, params map<string,string>, cv double"))
    assert sorted(((r["classifier"] or "", r["line_no"], r["cv"]) for r in best.collect())) == [("", 1, 3.0), ("a", 6, 6.0), ("c", None, 5.0)]
    assert "HashAggregate(keys=[classifier" in best._jdf.queryExecution().executedPlan().toString()
