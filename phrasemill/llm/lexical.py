"""Ranked lexical search by bag deduplication.

A document matters to a search by the terms it shares with the items and by its
length class ``m`` alone. Documents are cut down to the items' vocabulary;
those with the same bag of terms and the same ``m`` form a class, found by a
hash and told apart by the bags themselves. A class is scored once against all
items, every task keeps the best classes of each item, and the classes that are
left give their members by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch
from phrasemill.session import written

#: Bytes that separate terms become blanks, capitals become small; all bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TOP = 50
#: (item, term) pairs of a block of items; more items are searched block by block, each against all documents.
BLOCK_PAIRS = 1_000_000
#: Scores held at once by a task.
CELLS = 2_000_000
#: Classes with this many members for each one wanted are cut to their smallest ids before those are sorted: to the first
#: of these shares, of ten and a hundred times as many members to the second and third. A share is off by 0.0001 at most.
CROWD = 20
SHARES = [0.1, 0.01, 0.001]


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and other characters than ASCII, A-Z in lower case."""
    return text.encode().translate(FOLD).split()


def _filled(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) without repeats; rows of one item put their terms together."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, t) for i, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                 for t in set(terms_of(x))]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())],
                                          ["item", "term"])

    source = _filled(items.filter(F.col(item).isNotNull()), item, text)
    return source.mapInArrow(lambda batches: by_batch(batches, work), "item long, term binary").distinct()


@dataclass
class Index:
    """Items of a block: their ids, the vocabulary, and the items of each term end to end."""

    items: np.ndarray
    vocabulary: dict[bytes, int]
    first: np.ndarray
    of: np.ndarray

    @staticmethod
    def of_pairs(pairs: pa.Table) -> Index:
        ids, item = np.unique(pairs.column("item").to_numpy(), return_inverse=True)
        terms = pairs.column("term").to_pylist()
        vocabulary = {t: n for n, t in enumerate(sorted(set(terms)))}
        term = np.array([vocabulary[t] for t in terms], dtype=np.int64)
        order = np.lexsort((item, term))
        return Index(ids, vocabulary, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), item[order])


def _bags(docs: DataFrame, sent, key: str, text: str) -> DataFrame:
    """(id, n, bag): number of terms, and term numbers and frequencies over the vocabulary as 32-bit integers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = sent.value.vocabulary.get
        sizes, bags = [], []
        for text in batch.column("text").to_pylist():
            terms = terms_of(text)
            count = Counter(map(place, terms))
            count.pop(None, None)
            known = sorted(count)
            sizes.append(len(terms))
            bags.append(np.array([*known, *map(count.__getitem__, known)], dtype="<i4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["id", "n", "bag"])

    return _filled(docs, key, text).mapInArrow(lambda batches: by_batch(batches, work), "id long, n long, bag binary")


def _flat(bags: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each bag; terms and frequencies of all, end to end."""
    each = [np.frombuffer(b, "<i4") for b in bags]
    sizes = np.array([len(b) // 2 for b in each], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    return (sizes, np.concatenate([none, *(b[:len(b) // 2] for b in each)]).astype(np.int64),
            np.concatenate([none, *(b[len(b) // 2:] for b in each)]).astype(np.int64))


def _document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; a task hands on one row for each term at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("bag").to_pylist())[1], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "docs"])

    table = bags.select("bag").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[table.column("term").to_numpy()] = table.column("docs").to_numpy()
    return out


class _Best:
    """The best classes of each item so far; ties go to the smaller first id."""

    def __init__(self, items: int, top: int):
        self.top, self.floor, self.rows = top, np.ones(items, dtype=np.int64), np.zeros((4, 0), dtype=np.int64)

    def add(self, scores: np.ndarray, classes: np.ndarray, first: np.ndarray) -> None:
        """``scores``: a row for each class, a column for each item."""
        floor = self.floor
        if len(scores) > self.top:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        row, item = np.nonzero(scores >= floor)
        rows = np.concatenate([self.rows, [item, -scores[row, item], first[row], classes[row]]], axis=1)
        rows = rows[:, np.lexsort(rows[2::-1])]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, rank < self.top]
        last = self.rows[:, rank[rank < self.top] == self.top - 1]
        self.floor[last[0]] = -last[1]


def _scored(classes: DataFrame, sent, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, class): the best classes of each item, from every task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        items, many = len(index.items), np.diff(index.first)
        best, at_once = _Best(items, top), max(1, CELLS // max(items, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                sizes, term, tf = _flat(rows.column("bag").to_pylist())
                m = np.repeat(rows.column("m").to_numpy(), sizes)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                reps = many[term]
                within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
                cell = (np.repeat(np.repeat(np.arange(rows.num_rows), sizes) * items, reps)
                        + index.of[np.repeat(index.first[term], reps) + within])
                value = np.repeat(value, reps)
                if len(value) and int(value.max()) * int(sizes.max()) >= 1 << 53:  # doubles would round
                    scores = np.zeros(rows.num_rows * items, dtype=np.int64)
                    np.add.at(scores, cell, value)
                else:
                    scores = np.bincount(cell, weights=value, minlength=rows.num_rows * items).astype(np.int64)
                best.add(scores.reshape(rows.num_rows, items), rows.column("class").to_numpy(), rows.column("first").to_numpy())
        item, score, first, number = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(index.items[item]), pa.array(-score), pa.array(first), pa.array(number)],
                                         ["item", "score", "first", "class"])

    return classes.select("class", "m", "bag", "first").mapInArrow(run, "item long, score long, first long, class long")


def _search_block(docs: DataFrame, pairs: DataFrame, key: str, text: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    index = Index.of_pairs(pairs.toArrow())
    sent = spark.sparkContext.broadcast(index)
    bags = written(_bags(docs, sent, key, text), "bags")
    sizes = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counts = _document_counts(bags, len(index.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * sizes.docs + 2) / (2 * d + 1))) for d in counts.tolist()], dtype=np.int64)
    # 64-bit numbers would not hold the product for very many documents.
    m = F.expr(f"50 + (cast(50 * n as decimal(19, 0)) * cast({sizes.docs} as decimal(18, 0))) div {max(sizes.terms, 1)}")
    held = bags.filter((F.length("bag") > 0) & F.col("id").isNotNull()).select("id", m.cast("long").alias("m"), "bag")
    held = held.withColumn("hash", F.xxhash64("m", "bag"))
    same = ["hash", "m", "bag"]
    classes = written(held.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("members"))
                      .withColumn("class", F.monotonically_increasing_id()), "classes")
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    best = written(_scored(classes, sent, weights, top).withColumn("n", F.row_number().over(by_item)).filter(F.col("n") <= top)
                   .select("item", "class", "score"), "best")
    # At most ``top`` classes for each item of the block.
    chosen = written(classes.join(F.broadcast(best.select("class").distinct()), "class", "left_semi").drop("first"), "chosen")
    members = held.join(F.broadcast(chosen), same).select("class", "members", "id")
    # Of a crowd only the ids up to a quantile that surely has ``top`` below it.
    crowds = members.filter(F.col("members") >= CROWD * top)
    tenth = (F.when(F.col("members") >= 100 * CROWD * top, 2).when(F.col("members") >= 10 * CROWD * top, 1).otherwise(0))
    crowd = (crowds.groupBy("class", "members").agg(F.percentile_approx("id", F.array(*map(F.lit, SHARES)), 10_000).alias("most"))
             .select("class", F.get("most", tenth).alias("most")))
    least = (members.join(F.broadcast(crowd), "class", "left").filter("most is null or id <= most")
             .withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("n") <= top))
    ranked = (best.join(least.select("class", "id"), "class")
              .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))))
    return ranked.filter(F.col("rank") <= top).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP,
           block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of every item with a score above zero, best first.

    Equal scores are ordered by ascending ``key``. The score of a term is its
    weight, which falls with the number of documents that hold it, times a
    share that grows with its frequency and falls with the document's length,
    in whole numbers. Null and empty texts have no terms. Documents without a
    key count for lengths and weights and are not ranked, items without an id
    take no part; rows of one item are put together, repeated documents are
    ranked one by one. Items without terms and empty tables give no rows. Only
    the named columns are read.
    """
    pairs = written(item_terms(items, item, text), "items")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    parts = [pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_search_block(docs, p, key, text, top) for p in parts])
    return found.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


#: The same in SQL, over all documents and items.
SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
item_terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM benchmark, fold WHERE item_id IS NOT NULL),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM documents, fold),
lengths AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM held, sizes GROUP BY term),
marks AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM lengths, sizes),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM held JOIN weights USING (term) JOIN marks USING (doc_id) JOIN item_terms USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
