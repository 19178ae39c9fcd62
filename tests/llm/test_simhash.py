"""SimHash: fingerprints bit by bit, trees and components against all pairs, crowded shards, odd rows."""

import re

import numpy as np
import pytest
import xxhash

from phrasemill.llm.simhash import BKTree, components, fingerprint, hex_print, links, near_duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, radius=2):
    """Smallest position reachable, by all pairs."""
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius)
               for i in range(len(prints))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "A b C a B c a b c", "É é x y z", "x" * 900 + " y z w"])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)


def near(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    for _ in range(3):
        base = np.concatenate([base, base[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))])
    return np.unique(base)


def test_tree():
    prints = near(np.random.default_rng(2), 120)
    got = {(int(a), int(b)) for w, n in BKTree(prints).search(prints, 2) for a, b in zip(w, n, strict=True)}
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= 2)), strict=True))


@pytest.mark.parametrize("shard", [20_000, 40, 8])
def test_components(spark, shard):
    prints = near(np.random.default_rng(3), 80).astype(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components(links(df, 2, shard)).collect()}
    want = classes([int(p) % 2**64 for p in prints])
    groups = {}
    for p, c in zip(prints.tolist(), want, strict=True):
        groups.setdefault(c, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(5, text, "a"), (3, text, "b"), (5, text, "c"), (None, text, "d"), (9, None, "e"), (8, " ", "f"), (7, "other words here now", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.component) for r in near_duplicates(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("5", 3), ("None", 3), ("9", 8), ("8", 8), ("7", 7)])
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.filter("doc_id = 9")).select(hex_print("fp").alias("h")).first().h == "0" * 16


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text or "") for r in docs]
    want = {docs[i].doc_id: (f"{prints[i]:016x}", docs[c].doc_id) for i, c in enumerate(classes(prints))}
    from phrasemill.llm.queries import op9_simhash
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
