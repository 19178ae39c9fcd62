import json
import os
import time

import pytest
from pyspark.sql import functions as F

from phrasemill.operators.knn import KNNClassifier
from phrasemill.plans.score import score_texts, vectors_of
from phrasemill.session import shared_dir
from phrasemill.streaming.miner import confident_texts, mine, mine_to_table, mined, parse_messages, prefilter, stop_when_idle

MESSAGES = [
    {"id": 1, "lang": "en", "text": "ball goal ball goal ball"},
    {"id": 2, "lang": "en", "text": "ball goal"},
    {"id": 3, "lang": "fr", "text": "ball goal ball goal ball"},
    {"id": 4, "text": "ball goal ball goal ball"},
    {"id": 5, "lang": "en", "text": " söng sóng\nsong tune tune song"},
    {"id": 6, "lang": "en", "text": "vote law vote law vote law"},
]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([("ball", [1.0, 0.0, 0.0]), ("goal", [1.0, 0.1, 0.0]), ("song", [0.0, 1.0, 0.0]),
                                  ("tune", [0.0, 1.0, 0.1]), ("vote", [0.0, 0.0, 1.0]), ("law", [0.1, 0.0, 1.0])],
                                 "word string, vec array<float>").cache()


@pytest.fixture(scope="module")
def model(spark, vectors):
    texts = [(i, i % 3, " ".join([["ball", "goal"], ["song", "tune"], ["vote", "law"]][i % 3] * (1 + i // 3)))
             for i in range(12)]
    known = spark.createDataFrame(texts, "row_id long, label int, text string")
    return KNNClassifier(3).fit(vectors_of(known, vectors, ["row_id", "label"]))


def write(path, messages):
    path.write_text("\n".join(json.dumps(m) for m in messages) + "\n")


def test_stream_equals_batch(spark, vectors, model, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    write(source / "1.json", MESSAGES[:4])

    def run():
        stream = parse_messages(spark.readStream.text(str(source)))
        mine(stream, vectors, model, out, progress).awaitTermination()
        return {r.id: (r.text, r.prediction) for r in mined(spark, out).collect()}

    assert set(run()) == {1}
    write(source / "2.json", MESSAGES[4:])
    got = run()  # goes on where it stopped
    batch = prefilter(parse_messages(spark.read.text(str(source)))).withColumn("row_id", F.col("id"))
    want = {r.id: (r.text, r.prediction) for r in confident_texts(batch, vectors, model, 0.7, False).collect()}
    assert got == want
    # The line break joins the words around it; 6 falls in the last class, which does not count.
    assert got == {1: ("ball goal ball goal ball", 0), 5: ("song songsong tune tune song", 1)}
    assert run() == got


def test_idle_and_restart(spark, vectors, model, tmp_path):
    """A continuous query that stops when idle, one that is cut off at any moment, and a last run: nothing lost, nothing doubled."""
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    texts = [f"ball goal ball goal ball {i}x" for i in range(40)]

    def put(k):
        write(source / f"{k}.json", [{"id": i, "lang": "en", "text": texts[i]} for i in range(k * 10, k * 10 + 10)])

    def start(available_now=False):
        return mine(parse_messages(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))), vectors, model, out, progress,
                    available_now=available_now)

    put(0)
    query = start()
    assert stop_when_idle(query, 4.0) and not query.isActive and not stop_when_idle(query, 0.1)
    assert sorted(r.id for r in mined(spark, out).collect()) == list(range(10))
    put(1)
    put(2)
    cut = start()
    while not cut.status["isDataAvailable"] and not (cut.lastProgress and cut.lastProgress.numInputRows):
        time.sleep(0.02)
    cut.stop()  # in the midst of a batch, or between two
    put(3)
    start(available_now=True).awaitTermination()
    assert sorted(r.id for r in mined(spark, out).collect()) == list(range(40))


def test_last_class_on_request(spark, vectors, model):
    messages = spark.createDataFrame([(m["id"], m.get("lang"), m["text"]) for m in MESSAGES],
                                     "row_id long, lang string, text string")
    kept = prefilter(messages)
    assert sorted(r.row_id for r in kept.collect()) == [1, 5, 6]
    found = confident_texts(kept, vectors, model, 0.7, True)
    assert sorted(r.row_id for r in found.collect()) == [1, 5, 6]


def test_score_texts(spark, vectors, model):
    texts = spark.createDataFrame([(1, "A ball, goal! ball goal BALL goal"), (2, "#vote law vote law vote law")], "row_id long, text string")
    names = spark.createDataFrame([(0, "Sport"), (1, "Music"), (2, "Politics")], "idx int, name string")
    got = score_texts(model, texts, vectors, names, ["row_id"])
    best = {r.row_id: r.category for r in got.where(F.col("percent") > 50).collect()}
    assert best == {1: "Sport", 2: "Politics"}
    assert got.groupBy("row_id").agg(F.sum("percent").alias("s")).where("abs(s - 100) > 0.02").isEmpty()


def test_ids_do_not_matter(spark, vectors, model, tmp_path):
    """Messages without an id, and different ones with the same, are rows of their own."""
    source = tmp_path / "in"
    source.mkdir()
    texts = ["ball goal ball goal ball", "song tune song tune song", "ball goal ball goal ball", "goal ball goal ball goal"]
    write(source / "1.json", [{"lang": "en", "text": texts[0]}, {"lang": "en", "text": texts[1]}, {"id": 7, "lang": "en", "text": texts[2]},
                              {"id": 7, "lang": "en", "text": texts[1]}, {"id": None, "lang": "en", "text": texts[3]}, {"lang": "en"}])
    stream = parse_messages(spark.readStream.text(str(source)))
    got = mine_to_table(stream, vectors, model).collect()
    assert sorted((str(r.id), r.text, r.prediction) for r in got) == sorted(
        [("None", texts[0], 0), ("None", texts[1], 1), ("7", texts[2], 0), ("7", texts[1], 1), ("None", texts[3], 0)])


def test_no_message_ever(spark, vectors, model, tmp_path):
    (tmp_path / "in").mkdir()
    found = mine_to_table(parse_messages(spark.readStream.text(str(tmp_path / "in"))), vectors, model)
    assert found.columns == ["id", "text", "prediction", "best", "batch"] and found.count() == 0


def test_batches_leave_nothing_behind(spark, vectors, model, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.json", MESSAGES)
    before = set(os.listdir(shared_dir(spark)))
    mine_to_table(parse_messages(spark.readStream.text(str(tmp_path / "in"))), vectors, model).count()
    assert not [f for f in set(os.listdir(shared_dir(spark))) - before if f.startswith("messages-")]


def test_class_without_training_rows(spark, vectors):
    """Probabilities stand at their label's place, and a category that nobody trained has none."""
    texts = [(i, 2 * (i % 2), " ".join([["ball", "goal"], ["vote", "law"]][i % 2] * (1 + i // 2))) for i in range(8)]
    known = spark.createDataFrame(texts, "row_id long, label int, text string")
    gap = KNNClassifier(3).fit(vectors_of(known, vectors, ["row_id", "label"]))
    asked = spark.createDataFrame([(1, "vote law vote law vote")], "row_id long, text string")
    names = spark.createDataFrame([(0, "Sport"), (1, "Music"), (2, "Politics"), (3, "Other")], "idx int, name string")
    got = {r.category: r.percent for r in score_texts(gap, asked, vectors, names, ["row_id"]).collect()}
    assert got == {"Sport": 0.0, "Music": 0.0, "Politics": 100.0, "Other": 0.0}
    # With four categories, the third is a real one; the model alone would take it for the last.
    assert confident_texts(asked, vectors, gap, 0.7, False, classes=4).count() == 1
    assert confident_texts(asked, vectors, gap, 0.7, False).count() == 0
