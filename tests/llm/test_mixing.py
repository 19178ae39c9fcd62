"""Mixing by entropy balancing: targets, rates and copies against plain versions, odd sources, reruns."""

import math
import random
import re
from collections import defaultdict

import pytest

from phrasemill.llm.mixing import UNIT, _sizes, _sized, mix, mix_to, weighed_targets
from phrasemill.llm.queries import op11_entropy_mix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Target of each source, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        above = {s for s in order if s not in full and target[s] >= most * sizes[s]}
        if not above or not free:
            return target
        full |= above
        if len(full) == len(order):
            return {s: most * sizes[s] for s in order}


def plain_rates(sizes, target, most=2):
    """Rate of each size, the multiplier found by bisection."""
    if target >= most * sum(sizes):
        return dict.fromkeys(sizes, most)
    scale, low, high = sum(s * s for s in sizes) / sum(sizes), -1e6, 1e6
    rate = lambda x, s: most if x * s / scale >= math.log(most) else math.exp(x * s / scale)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(s * rate(middle, s) for s in sizes) < target else (low, middle)
    return {s: rate(low, s) for s in sizes}


def plain_copies(docs, target, most=2, repairs=3):
    """Copies of (size, id, units) rows by rounded running sums, and some single copies."""
    upto, copies = 0, []
    for _, _, units in docs:
        copies.append((upto + units + UNIT // 2) // UNIT - (upto + UNIT // 2) // UNIT)
        upto += units
    gap, changed = target - sum(c * d[0] for c, d in zip(copies, docs, strict=True)), set()
    for _ in range(repairs):
        can = [(abs(abs(gap) - size), size, i, k) for k, (size, i, _) in enumerate(docs) if k not in changed
               and (copies[k] < most if gap > 0 else copies[k] > 0) and abs(abs(gap) - size) < abs(gap)]
        if can:
            size, _, k = min(can)[1:]
            copies[k] += 1 if gap > 0 else -1
            gap -= size if gap > 0 else -size
            changed.add(k)
    return copies


def held_to_plain(rows, texts):
    """Rows of a mix (with the source at the end) against the plain versions."""
    docs, sizes = defaultdict(list), defaultdict(int)
    for i, text, source in texts:
        docs[source].append((len(WORDS.findall(text or "")), i))
        sizes[source] += docs[source][-1][0]
    targets = plain_targets(sizes)
    got = defaultdict(list)
    for r in rows:
        got[r.source].append(r)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
    assert set(got) == set(docs)
    for source, found in got.items():
        found.sort(key=lambda r: (r.size, r.doc_id))
        assert [(r.size, r.doc_id) for r in found] == sorted(docs[source])
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(targets[source], rel=1e-12) for r in found)
        if targets[source]:
            rates = plain_rates([r.size for r in found if r.size], targets[source]) | {0: 1.0}
            if targets[source] < 2 * sizes[source]:
                assert all(r.rate == pytest.approx(rates[r.size], abs=1e-4) for r in found)
            assert [r.copies for r in found] == plain_copies(
                [(r.size, r.doc_id, round(r.rate * UNIT)) for r in found], found[0].target)
        else:
            assert all(r.taken == 0 for r in found)
    return got


def made(seed):
    draw = random.Random(seed)
    texts = [(i, " ".join(["w"] * draw.choice([0, 1, 3, 10, 10, 30, draw.randint(1, 400)])), draw.choice("aaaaaaébcd")) for i in range(800)]
    texts += [(2000 + i, "tiny source", None) for i in range(3)] + [(3000 + i, "", "empty") for i in range(4)]
    return texts + [(4000, "x\x0by\x1cz q", "z"), (4001, None, "z"), (4002, "one", ""), (4003, "huge " * 5000, "b")]


def with_source(df, texts, spark):
    return df.join(spark.createDataFrame([(i, s) for i, _, s in texts], "doc_id long, source string"), "doc_id").collect()


def test_small(spark):
    texts = made(1)
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in texts], "doc_id long, text string, source string, of string, size int")
    rows = with_source(mix(docs.repartition(9)), texts, spark)
    got = held_to_plain(rows, texts)
    for source, found in got.items():
        size = max(r.size for r in found)
        assert abs(sum(r.taken for r in found) - found[0].target) <= max(size, 1), source
    again = with_source(mix(docs.repartition(3, "text")), texts, spark)
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_given_targets(spark):
    """Targets out of reach, of unknown sources and missing ones; repeated rows and ids."""
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "a", "s"), (None, "a b", "s"), (2, "a b", "t"), (3, "a", None)],
                                 "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 100.0), (None, 1.0), ("u", 5.0)], "source string, target double")
    got = sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in mix_to(docs, targets).collect())
    assert got == [("1", 1, 9, 18.0, 2), ("1", 3, 9, 18.0, 6), ("1", 3, 9, 18.0, 6), ("2", 2, 2, 0.0, 0), ("3", 1, 1, 1.0, 1), ("None", 2, 9, 18.0, 4)]


def test_targets(spark):
    draw = random.Random(3)
    sizes = {f"s{i}": draw.choice([0, 1, 5, 1000, draw.randint(1, 10**6)]) for i in range(60)} | {None: 77, "": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in weighed_targets(df, (3, 1, 2), 1.5, 2).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)
    with pytest.raises(ValueError):
        weighed_targets(df, (1,), 3.0, 2)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0 and _sizes(_sized(docs, "doc_id", "text", "source")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op11_entropy_mix(spark, folder)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    held_to_plain(with_source(got, texts, spark), texts)
