"""Every operator as a query over the stored tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasemill.functions.params import log_range
from phrasemill.functions.tokens import SMALL_NUMBERS, ascii_fold, is_dropped, raw_tokens, token_count
from phrasemill.functions.vectors import normalise, rounded
from phrasemill.operators import evaluate, words
from phrasemill.operators.embed import concat_embedding, sum_embedding
from phrasemill.operators.folds import nested_folds, stratified_folds, stratified_sample
from phrasemill.operators.knn import KNNClassifier, neighbours
from phrasemill.operators.lookup import attach_vectors, token_stream, unknown_words
from phrasemill.operators.select import expand_training_set, select_labelled
from phrasemill.operators.similar import most_similar, neighbour_pairs, pair_similarity
from phrasemill.plans import analysis, grid_search, search_all, sweep, tables
from phrasemill.plans.classifiers import unsettled
from phrasemill.plans.score import class_scores, fit_best, fit_classifier, is_confident, score_texts
from phrasemill.session import new_path, spread_small, written
from phrasemill.sources import results, texts, vectors as vector_source
from phrasemill.streaming.miner import mine_to_table, parse_messages, prefilter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
N = len(tables.CATEGORIES)
BEST = {"n_neighbors": 12, "weights": "distance", "p": 1}
BAND = 0.85  # share of held-out texts that every kind of model gets right
STUMPS = 0.6  # of forests with one split a tree
RECORDED = {"n_estimators": 1000, "criterion": "gini", "max_features": "sqrt", "max_depth": 20}  # the best forest on record


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f
    return add


# Texts and tokens

@query("labelled_scan")
def labelled_scan(spark, folder):
    lines = tables.texts(spark, folder).select("row_id", F.concat_ws(
        " ", F.col("label").cast("string"), F.regexp_replace("text", "[\r\n]+", " ")).alias("value"))
    return texts.parse_labelled(lines).select(
        "row_id", "label", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


@query("processed_lines")
def processed_lines(spark, folder):
    return tables.word_lists(spark, folder).select(
        "row_id", texts.processed_line(F.col("label"), F.col("words")).alias("line"))


@query("processed_roundtrip")
def processed_roundtrip(spark, folder):
    path = new_path(spark, "processed")
    texts.write_processed(tables.word_lists(spark, folder), path)
    return texts.read_processed(spark, path).select(
        "label", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


@query("category_dim")
def category_dim(spark, folder):
    path = new_path(spark, "descriptor")
    texts.write_descriptor(tables.table(spark, folder, "documents").agg(
        F.lit("documents by language").alias("Title"), F.sort_array(F.collect_set("lang")).alias("Categories"),
        F.count("*").cast("int").alias("Size")), path)
    return texts.category_dim(texts.read_descriptor(spark, path))


@query("tokenize")
def tokenize(spark, folder):
    return tables.word_lists(spark, folder).select(
        "row_id", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.md5(F.array_join("words", " ")).alias("digest"))


@query("token_filter_counts")
def token_filter_counts(spark, folder):
    tokens = tables.texts(spark, folder).select("label", F.explode(raw_tokens(F.col("text"))).alias("t"))
    return tokens.groupBy("label").agg(
        F.count("*").alias("tokens"), F.count_if(is_dropped(F.col("t"))).alias("dropped"))


@query("number_words")
def number_words(spark, folder):
    tokens = tables.word_lists(spark, folder).select("label", F.explode("words").alias("word"))
    return tokens.where(F.col("word").isin(SMALL_NUMBERS)).groupBy("label", "word").agg(F.count("*").alias("n"))


@query("ascii_fold")
def ascii_fold_texts(spark, folder):
    return tables.texts(spark, folder).select("row_id", ascii_fold("text").alias("t")).select(
        "row_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def _messages(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("doc_id").alias("id"), "lang", "text")


@query("stream_prefilter")
def stream_prefilter(spark, folder):
    stored = spread_small(tables.table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    return prefilter(_messages(stored)).select(
        F.col("id").alias("row_id"), token_count(F.col("text")).alias("n_tokens"), F.md5("text").alias("digest"))


# Words

@query("unique_words")
def unique_words(spark, folder):
    return words.unique_words(tables.word_lists(spark, folder))


@query("word_category_counts")
def word_category_counts(spark, folder):
    return words.category_counts(tables.word_lists(spark, folder), longer_than=2)


def _frequent(spark, folder):
    lists = tables.word_lists(spark, folder)
    return words.frequent_words(lists, tables.ranked_vectors(spark, folder, lists), N)


def _counts():
    return [F.get("counts", F.lit(i)).alias(f"n_{c}") for i, c in enumerate(tables.CATEGORIES)]


@query("frequent_words")
def frequent_words(spark, folder):
    return _frequent(spark, folder).select("word", "total", *_counts())


@query("dominant_category")
def dominant_category(spark, folder):
    profile = words.category_profile(tables.word_lists(spark, folder), N)
    return profile.select("word", words.dominant(F.col("counts")).alias("label"), "total")


@query("word_category_mix")
def word_category_mix(spark, folder):
    mixed = _frequent(spark, folder).select("word", *words.mixed_colour(F.col("counts")))
    return mixed.select("word", *[rounded(F.col(c)).alias(c) for c in ("red", "green", "blue")])


@query("top_words_per_category")
def top_words_per_category(spark, folder):
    return words.top_words(_frequent(spark, folder)).select("category", "place", "word", "total")


@query("word_vectors")
def word_vectors(spark, folder):
    stored = tables.ranked_vectors(spark, folder, tables.word_lists(spark, folder))
    parsed = vector_source.parse_vector_lines(vector_source.vector_lines(stored), "rank")
    units = F.transform("vec", lambda v: F.round(v.cast("double") * 1_000_000).cast("long"))
    return parsed.join(stored.select("word", "rank", "df"), "word").select(
        "word", "rank", "df", F.size("vec").alias("dim"),
        F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("vocab_coverage")
def vocab_coverage(spark, folder):
    lists = tables.word_lists(spark, folder)
    return words.coverage(words.unique_words(lists), tables.ranked_vectors(spark, folder, lists))


@query("oov_words")
def oov_words(spark, folder):
    lists = tables.word_lists(spark, folder)
    return unknown_words(words.document_frequency(lists), tables.ranked_vectors(spark, folder, lists))


@query("token_vectors")
def token_vectors(spark, folder):
    lists = tables.word_lists(spark, folder)
    tokens = token_stream(lists, ["row_id"])
    found = attach_vectors(tokens, tables.ranked_vectors(spark, folder, lists), "inner")
    return found.groupBy("row_id").agg(
        F.count("*").alias("covered"), F.min("pos").alias("first_pos"), F.sum("rank").alias("rank_sum"),
        F.sum(F.round(F.col("vec")[0].cast("double") * 1_000_000).cast("long")).alias("units"))


@query("most_similar")
def most_similar_words(spark, folder):
    return most_similar(tables.ranked_vectors(spark, folder, tables.word_lists(spark, folder)), "the")


@query("pairwise_similarity")
def pairwise_similarity(spark, folder):
    lists = tables.word_lists(spark, folder)
    return pair_similarity(neighbour_pairs(lists), tables.ranked_vectors(spark, folder, lists))


# Text vectors

def _exploded(df: DataFrame, keep: list[str], vec: str = "features") -> DataFrame:
    return df.select(*keep, F.posexplode(vec).alias("pos", "value")).withColumn("value", rounded(F.col("value")))


def _embedded(spark, folder, embedding):
    lists = tables.word_lists(spark, folder)
    return embedding(lists, tables.ranked_vectors(spark, folder, lists), ["row_id", "label"])


@query("sum_embedding")
def sum_embedding_texts(spark, folder):
    return _exploded(_embedded(spark, folder, sum_embedding), ["row_id", "label"])


@query("concat_embedding")
def concat_embedding_texts(spark, folder):
    units = F.transform("features", lambda v, i: F.round(v * 1_000_000).cast("long") * (i + 1))
    return _embedded(spark, folder, concat_embedding).select(
        "row_id", "label", F.size("features").alias("dim"),
        F.size(F.filter("features", lambda v: v != 0)).alias("filled"),
        F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


# Folds

@query("class_balance")
def class_balance(spark, folder):
    return evaluate.class_balance(tables.word_lists(spark, folder))


@query("stratified_folds")
def stratified_folds_points(spark, folder):
    return stratified_folds(tables.points(spark, folder).select("row_id", "label"), 5)


@query("folds_sparse_ids")
def folds_sparse_ids(spark, folder):
    """Folds over ids far apart, as hashes are."""
    far = (F.col("row_id") * 7919 % 1000003) * (1 << 32) + F.col("row_id")
    return stratified_folds(tables.points(spark, folder).select(far.alias("row_id"), "label"), 5)


@query("labelled_file_folds")
def labelled_file_folds(spark, folder):
    """Folds over the lines of text files, numbered as they stand in the files."""
    path = new_path(spark, "lines")
    lines = tables.texts(spark, folder).repartitionByRange("row_id").sortWithinPartitions("row_id").select(
        F.concat_ws(" ", F.col("label").cast("string"), F.regexp_replace("text", "[\r\n]+", " ")).alias("value"))
    lines.write.text(path)
    return stratified_folds(texts.read_labelled(spark, path).select("row_id", "label"), 5)


@query("nested_folds")
def nested_folds_points(spark, folder):
    cut = nested_folds(tables.points(spark, folder).select("row_id", "label"), 5)
    return cut.withColumn("cv_fold", F.coalesce("cv_fold", F.lit(-1)))


@query("stratified_sample")
def stratified_sample_texts(spark, folder):
    rows = tables.texts(spark, folder).select("row_id", "label")
    return stratified_sample(rows, rows.count(), N)


@query("train_test_complement")
def train_test_complement(spark, folder):
    rows = tables.points(spark, folder).select("row_id", "label")
    test = stratified_folds(rows, 5).where(F.col("fold") == 0).select("row_id", "label")
    return rows.exceptAll(test)


@query("param_grid")
def param_grid(spark, folder):
    """The work list of a search: every setting with the rows of each fold."""
    cut = stratified_folds(tables.points(spark, folder).select("row_id", "label"), 5)
    sizes = cut.groupBy("fold").agg(F.count("*").alias("n_test"))
    total = F.lit(cut.count())
    return (sizes.withColumn("n_train", total - F.col("n_test"))
            .withColumn("C", F.explode(log_range(3, 12)))
            .withColumn("gamma", F.explode(F.transform(log_range(-7, -2), lambda g: F.round(g, 12)))))


# Nearest neighbours

def _held_out(spark, folder):
    return grid_search.split_rows(tables.points(spark, folder))


def _predicted(spark, folder, **settings):
    split = _held_out(spark, folder)
    return KNNClassifier(**settings).fit(split.where(~F.col("is_test"))).transform(split.where("is_test"))


@query("knn_neighbors")
def knn_neighbors(spark, folder):
    split = _held_out(spark, folder)
    found = neighbours(split.where("is_test").select("row_id", "vec"), split.where(~F.col("is_test")), 12, 2)
    return found.select("row_id", F.posexplode("neighbours").alias("place", "n")).select(
        "row_id", "place", F.col("n.row_id").alias("neighbour_id"), rounded(F.col("n.distance")).alias("distance"))


@query("knn_cells")
def knn_cells(spark, folder):
    """The same search by the way for training sets that are too big to send out."""
    split = _held_out(spark, folder)
    found = neighbours(split.where("is_test").select("row_id", "vec"), split.where(~F.col("is_test")), 12, 2, budget=0)
    return found.select("row_id", F.posexplode("neighbours").alias("place", "n")).select(
        "row_id", "place", F.col("n.row_id").alias("neighbour_id"), rounded(F.col("n.distance")).alias("distance"))


@query("knn_predict")
def knn_predict(spark, folder):
    return _predicted(spark, folder, n_neighbors=12, p=2).select("row_id", "label", "prediction")


@query("knn_predict_weighted")
def knn_predict_weighted(spark, folder):
    return _predicted(spark, folder, **BEST).select("row_id", "label", "prediction")


@query("knn_proba")
def knn_proba(spark, folder):
    return _exploded(_predicted(spark, folder, n_neighbors=12, p=3), ["row_id"], "probability")


@query("normalise_proba")
def normalise_proba(spark, folder):
    scored = _predicted(spark, folder, **BEST).withColumn("share", normalise(F.col("votes")))
    return _exploded(scored, ["row_id"], "share")


@query("confident_filter")
def confident_filter(spark, folder):
    scored = _predicted(spark, folder, n_neighbors=5, p=2)
    return scored.where(is_confident(0.4)).select(
        "row_id", "prediction", rounded(F.array_max("probability")).alias("best"))


@query("evaluate_split")
def evaluate_split(spark, folder):
    return grid_search.evaluate_knn(_held_out(spark, folder), BEST)


@query("cross_validate_knn")
def cross_validate_knn(spark, folder):
    return grid_search.cross_validate_knn(tables.points(spark, folder), 5, {"n_neighbors": 12, "p": 2})


@query("cv_micro")
def cv_micro(spark, folder):
    predictions = grid_search.knn_predictions_by_fold(tables.points(spark, folder), 5, grid_search.KNN_GRID)
    return evaluate.cv_micro(predictions, "n_neighbors", "p", "weights")


@query("cv_macro")
def cv_macro(spark, folder):
    predictions = grid_search.knn_predictions_by_fold(tables.points(spark, folder), 5, grid_search.KNN_GRID)
    return evaluate.cv_macro(predictions, "n_neighbors", "p", "weights")


@query("grid_search_knn")
def grid_search_knn(spark, folder):
    return grid_search.knn_grid_search(_held_out(spark, folder))


@query("misclassified")
def misclassified(spark, folder):
    rows, _ = tables.text_points(spark, folder)
    split = grid_search.split_rows(rows)
    predicted = KNNClassifier(**BEST).fit(split.where(~F.col("is_test"))).transform(split.where("is_test"))
    wrong = evaluate.misclassified(predicted).select("row_id", "label", "prediction")
    listed = tables.word_lists(spark, folder).select("row_id", F.array_join("words", " ").alias("text"))
    return wrong.join(listed, "row_id")


@query("score_texts")
def score_texts_chat(spark, folder):
    rows, vectors = tables.text_points(spark, folder)
    model = KNNClassifier(**BEST).fit(rows)
    return score_texts(model, tables.chat_texts(spark, folder), vectors, tables.categories(spark),
                       ["row_id", "conv_id", "turn"]).drop("row_id")


@query("mine_stream")
def mine_stream(spark, folder):
    rows, vectors = tables.text_points(spark, folder)
    model = KNNClassifier(n_neighbors=12, p=1).fit(rows)
    return mine_to_table(_message_stream(spark, folder), vectors, model).select(
        F.col("id").alias("row_id"), "prediction", "best", F.md5("text").alias("digest"))


def _message_stream(spark, folder):
    schema = tables.table(spark, folder, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(folder)
    return _messages(stream)


@query("mine_messages")
def mine_messages(spark, folder):
    """A stream of JSON messages, a third of them without an id and the others with ids that repeat."""
    path = new_path(spark, "messages")
    some_id = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7)
    tables.table(spark, folder, "documents").select(
        F.to_json(F.struct(some_id.alias("id"), "lang", "text")).alias("value")).write.text(path)
    rows, vectors = tables.text_points(spark, folder)
    model = KNNClassifier(n_neighbors=12, p=1).fit(rows)
    return mine_to_table(parse_messages(spark.readStream.text(path)), vectors, model).select(
        F.coalesce("id", F.lit(-1)).alias("id"), "prediction", "best", F.md5("text").alias("digest"))


def _best_model(spark, folder, rows):
    """The best setting of the result log, read as a log of neighbour searches."""
    lines = tables.result_lines(spark, folder).withColumn("classifier", F.lit("NearestNeighborsAlgorithm"))
    return fit_best(results.parse_results(lines), rows, N)


@query("score_best")
def score_best(spark, folder):
    rows, vectors = tables.text_points(spark, folder)
    return score_texts(_best_model(spark, folder, rows), tables.chat_texts(spark, folder), vectors,
                       tables.categories(spark), ["row_id", "conv_id", "turn"]).drop("row_id")


@query("mine_best")
def mine_best(spark, folder):
    rows, vectors = tables.text_points(spark, folder)
    found = mine_to_table(_message_stream(spark, folder), vectors, _best_model(spark, folder, rows), classes=N)
    return found.select(F.col("id").alias("row_id"), "prediction", "best", F.md5("text").alias("digest"))


# Choosing texts

@query("select_labelled")
def select_labelled_texts(spark, folder):
    answers = tables.table(spark, folder, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "skip").when(F.col("toxic") == 1, "9")
        .when(F.col("quality") == 1, "en").otherwise("2").alias("answer"))
    documents = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")
    chosen = select_labelled(documents, answers, tables.categories(spark))
    return chosen.select("row_id", "label", F.md5("text").alias("digest"))


@query("expand_training_set")
def expand_training_set_texts(spark, folder):
    documents = tables.texts(spark, folder)
    known = tables.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"))
    return expand_training_set(documents.join(known, "row_id", "left_semi"),
                               documents.join(known, "row_id", "left_anti")).select("row_id", "label")


# Result tables

def _results(spark, folder):
    return results.parse_results(tables.result_lines(spark, folder))


def _evaluations(spark, folder):
    return results.parse_evaluations(tables.evaluation_lines(spark, folder))


@query("parse_grid_results")
def parse_grid_results(spark, folder):
    names = ["hidden_layer_sizes", "max_depth", "n_neighbors", "p", "weights", "Sentence Embedding", "Word Embedding"]
    return _results(spark, folder).select(
        "line_no", "classifier", "word_emb", "word_emb_path", "dim", "sent_emb", "cv",
        *[F.col("params")[n].alias(n.lower().replace(" ", "_")) for n in names])


@query("read_result_folder")
def read_result_folder(spark, folder):
    """Result, evaluation and sweep files of several classifiers side by side in a folder, and what is read of each kind."""
    path = new_path(spark, "summaries")
    lines, told = tables.result_lines(spark, folder), tables.evaluation_lines(spark, folder)
    for name in tables.RUNS:
        results.write_lines(lines.where(F.col("classifier") == name), path, "log_of", name, results.RESULTS)
        for split, kind in (("test", results.EVALUATION), ("train", results.TRAIN_EVALUATION)):
            results.write_lines(told.where((F.col("classifier") == name) & (F.col("split") == split)), path, "log_of", name, kind)
    results.write_lines(told.select(F.lit("3;0.5;0.25;1.0").alias("value")), path, "log_of", "view", "pca")
    read = [results.read_results(spark, path).select("classifier", F.lit("result").alias("kind"), "word_emb", "sent_emb", F.col("cv").alias("score")),
            *[results.read_evaluations(spark, path, s).select("classifier", F.col("split").alias("kind"), "word_emb", "sent_emb", "score")
              for s in ("test", "train")]]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("classifier", "kind", "word_emb", "sent_emb").agg(
        F.count("*").alias("n"), F.sum(F.round(100 * F.col("score")).cast("long")).alias("hundredths"))


BEST_COLUMNS = ["classifier", "line_no", "word_emb", "word_emb_params", "sent_emb", "cv"]


@query("best_params")
def best_params(spark, folder):
    return analysis.best_params(_results(spark, folder)).select(
        *BEST_COLUMNS, F.col("params")["n_neighbors"].alias("n_neighbors"))


@query("best_with_evaluation")
def best_with_evaluation(spark, folder):
    return analysis.best_with_evaluation(_results(spark, folder), _evaluations(spark, folder)).select(
        *BEST_COLUMNS, "test_score", "train_score")


@query("best_overall")
def best_overall(spark, folder):
    return analysis.best_overall(_results(spark, folder), tables.RUNS).select(*BEST_COLUMNS)


@query("grid_summary")
def grid_summary(spark, folder):
    return analysis.grid_summary(_results(spark, folder))


@query("model_ranking")
def model_ranking(spark, folder):
    return analysis.model_ranking(_results(spark, folder), _evaluations(spark, folder))


@query("emb_compare")
def emb_compare(spark, folder):
    return analysis.by_sentence_embedding(_results(spark, folder))


@query("running_max_avg")
def running_max_avg(spark, folder):
    return analysis.running_max_average(_results(spark, folder))


@query("param_profile")
def param_profile(spark, folder):
    return analysis.param_profile(_results(spark, folder), "n_neighbors")


@query("param_values")
def param_values(spark, folder):
    return analysis.param_values(_results(spark, folder), "n_neighbors")


@query("param_pair_profile")
def param_pair_profile(spark, folder):
    pairs = analysis.param_pair_profile(_results(spark, folder), "n_neighbors", "p")
    return pairs.select("classifier", "first", "second", "highest", "capped",
                        rounded(F.col("log2_first")).alias("log2_first"),
                        rounded(F.col("log2_second")).alias("log2_second"))


# Fitted models: values depend on random draws, so a row tells whether label and probabilities agree, whether
# the model is as good as it should be, and whether its fit came to rest

def _fitted(spark, folder, name, **settings):
    rows, _ = tables.text_points(spark, folder)
    split = grid_search.split_rows(rows)
    model = fit_classifier(name, settings, split.where(~F.col("is_test")), N)
    scored = written(class_scores(model, split.where("is_test")).select("row_id", "label", "prediction", "probability"), "scored")
    right = scored.agg(F.avg(evaluate.correct())).first()[0]
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    likeliest = F.get("probability", F.col("prediction")) >= F.array_max("probability") - 1e-9
    return scored.select(
        "row_id", "label", (likeliest & (F.abs(total - 1) < 1e-6) & (F.size("probability") == N)).alias("consistent"),
        F.lit(right >= BAND).alias("in_band"), F.lit(not unsettled(model)).alias("settled"))


@query("rf_predict")
def rf_predict(spark, folder):
    return _fitted(spark, folder, "RandomForestAlgorithm", **RECORDED)


@query("mlp_predict")
def mlp_predict(spark, folder):
    return _fitted(spark, folder, "MLPAlgorithm")


@query("svm_predict")
def svm_predict(spark, folder):
    return _fitted(spark, folder, "SvmAlgorithm", C=1000.0, gamma=1e-5)


@query("grid_search_rf")
def grid_search_rf(spark, folder):
    rows, _ = tables.text_points(spark, folder)
    found, _ = grid_search.grid_search(rows, "RandomForestAlgorithm")
    stump = F.col("params").contains("'max_depth': 1,")
    return found.select("classifier", "line_no", "word_emb", "word_emb_params", "sent_emb", "params",
                        (F.col("cv") >= F.when(stump, 100 * STUMPS).otherwise(100 * BAND)).alias("in_band"))


@query("grid_search_mlp")
def grid_search_mlp(spark, folder):
    rows, _ = tables.text_points(spark, folder)
    found, _ = grid_search.grid_search(rows, "MLPAlgorithm")
    return found.select("classifier", "line_no", "word_emb", "word_emb_params", "sent_emb", "params", (F.col("cv") >= 100 * BAND).alias("in_band"))


@query("grid_search_all")
def grid_search_all(spark, folder):
    """Two tables of word vectors, the second one with the first half of the dimensions, times two kinds of text vectors."""
    lists = written(tables.word_lists(spark, folder), "lists")
    whole = tables.ranked_vectors(spark, folder, lists)
    half = whole.withColumn("vec", F.slice("vec", F.lit(1), F.lit(tables.DIM // 2)))
    found, _ = search_all.search_all(
        lists, {("TableEmbedding", "whole,64"): whole, ("TableEmbedding", "half,32"): half},
        {"SumEmbedding": sum_embedding, "ConcatenationEmbedding": concat_embedding}, {"NearestNeighborsAlgorithm": tables.SOME_NEIGHBOURS},
        new_path(spark, "search"))
    return results.parse_results(found.withColumn("value", results.result_line(
        F.col("word_emb"), F.col("word_emb_params"), F.col("sent_emb"), F.col("params"), F.col("cv"))).select("classifier", "value")).select(
            "classifier", "word_emb_params", "sent_emb", F.col("params")["n_neighbors"].cast("int").alias("n_neighbors"),
            F.col("params")["weights"].alias("weights"), "cv")


@query("decision_trees")
def decision_trees(spark, folder):
    """What each tree of a small forest on the first two components says over a mesh."""
    rows, _ = tables.text_points(spark, folder)
    return sweep.tree_grid(rows, N, {"n_estimators": 5, "max_depth": 5}, 100)


@query("pca_project")
def pca_project(spark, folder):
    return sweep.projected(tables.points(spark, folder), 8, ["row_id", "label"])


@query("project_texts_3d")
def project_texts_3d(spark, folder):
    rows, _ = tables.text_points(spark, folder)
    return sweep.projected(rows, 3, ["row_id", "label"])


@query("project_words_3d")
def project_words_3d(spark, folder):
    lists = tables.word_lists(spark, folder)
    vectors = tables.ranked_vectors(spark, folder, lists)
    top = words.top_words(words.frequent_words(lists, vectors, N))
    shown = vectors.join(top.select("word", "category"), "word")
    return sweep.projected(shown, 3, ["word", "category"], fit_on=vectors)


@query("pca_sweep")
def pca_sweep(spark, folder):
    path = new_path(spark, "sweep")
    results.write_sweep(sweep.pca_sweep(tables.points(spark, folder), "NearestNeighborsAlgorithm", BEST), path)
    return results.read_sweep(spark, path)


@query("pca_sweep_models")
def pca_sweep_models(spark, folder):
    """Accuracy of three kinds of classifiers over texts against the number of components."""
    rows, _ = tables.text_points(spark, folder)
    found = [sweep.pca_sweep(rows, name, settings, count=8).select(F.lit(name).alias("classifier"), "dims", "is_pca", "acc", "rel_train", "rel_test")
             for name, settings in (("NearestNeighborsAlgorithm", BEST), ("RandomForestAlgorithm", {"n_estimators": 100}), ("MLPAlgorithm", {"activation": "relu"}))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("sweep_without_pca")
def sweep_without_pca(spark, folder):
    """Right answers of the neighbour search in each fold, on the vectors as they are and on all their components, which is a rotation."""
    cut = written(stratified_folds(tables.points(spark, folder), 5), "folds")
    dim = cut.select(F.size("vec")).first()[0]
    return sweep.fold_sweep(cut, "NearestNeighborsAlgorithm", {"n_neighbors": 12, "p": 2}, [None, dim], "fold", 5, 10).select(
        F.col("fold").cast("int").alias("fold"), "is_pca", "hits", "n")

@query("decision_grid")
def decision_grid(spark, folder):
    rows, _ = tables.text_points(spark, folder)
    return sweep.decision_grid(rows, KNNClassifier(n_neighbors=12))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return top_words_per_category(spark, folder)
