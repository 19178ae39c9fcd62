import random

import pytest
from pyspark.sql import functions as F

from phrasemill.operators.folds import nested_folds, sample_folds, stratified_folds, stratified_sample
from phrasemill.operators.slices import global_rank, running_max

ROWS = [(i, 0 if i < 60 else i % 3) for i in range(100)] + [(200, 7), (205, 7)]


def blocks(n, folds):
    """Sizes of the blocks: the first ``n % folds`` are one longer."""
    return [n // folds + (1 if i < n % folds else 0) for i in range(folds)]


def folds_by_hand(rows, folds):
    out = {}
    for label in {c for _, c in rows}:
        ids = sorted(i for i, c in rows if c == label)
        for fold, size in enumerate(blocks(len(ids), folds)):
            for i in ids[:size]:
                out[i] = fold
            ids = ids[size:]
    return out


@pytest.mark.parametrize("parts", [1, 7, None])
@pytest.mark.parametrize("folds", [3, 5])
def test_folds(spark, folds, parts):
    df = spark.createDataFrame(ROWS, "row_id long, label int").orderBy(F.rand(3))
    got = {r.row_id: r.fold for r in stratified_folds(df, folds, parts=parts).collect()}
    assert got == folds_by_hand(ROWS, folds)


def test_nested(spark):
    df = spark.createDataFrame(ROWS, "row_id long, label int")
    got = {r.row_id: (r.is_test, r.cv_fold) for r in nested_folds(df, 5).collect()}
    outer = folds_by_hand(ROWS, 5)
    inner = folds_by_hand([(i, c) for i, c in ROWS if outer[i] > 0], 5)
    assert got == {i: (outer[i] == 0, None if outer[i] == 0 else inner[i]) for i, _ in ROWS}


def test_sample(spark):
    assert sample_folds(1527, 7) == 3 and sample_folds(7184, 4) == 17
    df = spark.createDataFrame(ROWS, "row_id long, label int")
    got = {r.row_id for r in stratified_sample(df, 102, 4).collect()}
    assert got == {i for i, f in folds_by_hand(ROWS, 3).items() if f == 0}


@pytest.mark.parametrize("parts", [1, 5, None])
def test_running_max(spark, parts):
    rng = random.Random(5)
    rows = [(i, "a" if rng.random() < 0.7 else "b", rng.randint(0, 1000) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "line_no long, g string, v double")
    got = {r.line_no: r.m for r in running_max(df, ["g"], "line_no", "v", "m", parts).collect()}
    top, want = {}, {}
    for i, g, v in rows:
        top[g] = max(top.get(g, v), v)
        want[i] = top[g]
    assert got == want


def test_global_rank(spark):
    rows = [(f"w{i:03d}", i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "word string, df int").repartition(6)
    got = {r.word: r["rank"] for r in global_rank(df, F.desc("df"), F.asc("word")).collect()}
    assert got == {w: i for i, (w, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_ids_far_apart(spark):
    """A class of any ids is ranked in parts, not by one task."""
    rows = [((i * 7919 % 1000003) << 40, i % 2) for i in range(400)]
    got = {r.row_id: r.fold for r in stratified_folds(spark.createDataFrame(rows, "row_id long, label int"), 5).collect()}
    assert got == folds_by_hand(rows, 5)
    df = stratified_folds(spark.createDataFrame(rows, "row_id long, label int"), 5)
    assert "Window [row_number" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_of_lines_follow_the_data(spark):
    """No fixed number of files: with more parts a task writes and reads less."""
    from pathlib import Path

    from phrasemill.plans.queries import QUERIES
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before, merge = set(shared.glob("lines-*")), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        QUERIES["labelled_file_folds"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(merge)
    (path,) = set(shared.glob("lines-*")) - before
    assert len(list(path.glob("part-*"))) > 4
