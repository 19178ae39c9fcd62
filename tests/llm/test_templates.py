"""Decontamination: exact and reworded items, slots that do not fit, short items, odd rows; documents against plain search."""

import re

from phrasemill.llm.queries import op1_templates
from phrasemill.llm.templates import canonical, contaminated

ITEM = "A train leaves Berlin at 9 and drives 300 km in 3 hours. How many km does the train drive in 1 hour if Anna waits?"


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}


def test_placeholders():
    plain, named, kinds, tokens = canonical("He met Anna. The 5 km and 7% km rule 1,000.5 $")
    assert tokens == ["He", "met", "Anna", "The", "5", "km", "and", "7", "%", "km", "rule", "1,000.5", "$"]
    assert kinds.tolist() == [0, 0, 1, 0, 2, 3, 0, 2, 3, 0, 0, 2, 3] and (plain != named).sum() == 1


def test_exact_and_reworded(spark):
    other = ITEM.replace("9", "7").replace("300", "450").replace(" 3 ", " 5 ").replace("Berlin", "Paris").replace("Anna", "Zoe").replace("km", "miles")
    got = found(spark, ["Before it. " + ITEM.upper() + " After it.", "words " * 50 + other, "Something else that is clean and long enough to have windows."])
    assert got.keys() == {(0, 0), (1, 0)}
    assert not got[0, 0].reworded and got[1, 0].reworded and got[1, 0].share > 0.8


def test_names_that_open_sentences(spark):
    item = "Anna has 3 apples. Tom gives her 4 more. Lisa eats 2 of them. How many apples are left?"
    other = item.replace("Anna", "Zoe").replace("Tom", "Carl").replace("Lisa", "Mia").replace("3", "8").replace("4", "5")
    inside = "we ask you now, as " + other  # the first token no longer opens a sentence
    wrong = item.replace("Anna", "Zoe").replace("Tom", "Zoe").replace("Lisa", "Zoe").replace("3", "4").replace("2", "4")
    got = found(spark, [other, inside, wrong], (item,))
    assert got.keys() == {(0, 0), (1, 0)} and all(r.reworded and r.share == 1 for r in got.values())
    lower = "then the train leaves Paris at 7 and drives on"  # the opening capital is a word here
    assert found(spark, [lower], ("The train leaves Berlin at 9 and drives on",)).keys() == {(0, 0)}


def test_mostly_numbers(spark):
    sums = "12 + 7 = 19, 30 + 4 = 34, 8 + 9 = 17 and 5 km 3 m 2 cm 40 kg 6 g 15 %"
    other = re.sub(r"\d+", lambda m: str(int(m[0]) + 1), sums)
    short = "3 5 7 11 primes"
    got = found(spark, ["Solve: " + sums + " now", other, "the 3 5 7 11 primes", "the 3 5 7 13 primes", "km " + sums], (sums, short))
    assert got.keys() == {(0, 0), (2, 1), (4, 0)} and got[0, 0].share == 1 and not got[0, 0].reworded


def test_more_windows_than_are_broadcast(spark, monkeypatch):
    few = found(spark, [ITEM, ITEM.replace("Anna", "Zoe")])
    monkeypatch.setattr("phrasemill.llm.templates.BROADCAST_WINDOWS", 0)
    assert found(spark, [ITEM, ITEM.replace("Anna", "Zoe")]) == few and len(few) == 2


def test_slots_must_fit(spark):
    item = "take 5 apples and put 5 apples into 5 bags then sell 7 apples and keep 5 bags for 7 more days at home"
    fits = item.replace("5", "8").replace("7", "9")
    numbers = iter("1 2 3 4 5 6 7 8".split())
    mixed = re.sub(r"\d", lambda m: next(numbers), item)
    got = found(spark, [fits, mixed], (item,))
    assert (0, 0) in got and got[0, 0].reworded
    assert (1, 0) not in got


def test_partial_and_short(spark):
    long = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("one", "two", "tre", "fou", "fiv"))
    words = long.split()
    got = found(spark, [" ".join(words[3:16]), " ".join(words[3:13]), "say pure red fox now", "pure red", "the pure blue fox"],
                (long, "pure red fox now", "pure red", "", None))
    assert got.keys() == {(0, 0), (2, 1)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM), (None, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == [(3, 1), (3, 2)]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    words = lambda t: re.findall(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*", (t or "").lower())
    bench = {r.item_id: words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = set()
    for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = " " + " ".join(words(d.text)) + " "
        want |= {(d.doc_id, i) for i, w in bench.items() if any(f" {' '.join(w[k:k + 13])} " in text for k in range(max(len(w) - 12, 1)))}
    got = {(r.doc_id, r.item_id) for r in op1_templates(spark, folder).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)
