"""The forest search covers the whole recorded grid, and grows each forest once for all its depths."""

from phrasemill.plans import grid_search, queries
from phrasemill.plans.classifiers import CLASSIFIERS, combinations


def test_whole_grid(spark, monkeypatch):
    grown, whole = [], grid_search.grow_forest

    def few(rows, classes, trees, growth, apart=None, parts=1):
        grown.append((trees, growth.criterion, growth.features, growth.max_depth, parts))
        return whole(rows, classes, 20, growth, apart, parts)

    monkeypatch.setattr(grid_search, "grow_forest", few)
    found = queries.QUERIES["grid_search_rf"](spark, "/root/testdata/sf0.001").collect()
    assert [r.line_no for r in found] == list(range(36)) == list(range(len(combinations(CLASSIFIERS["RandomForestAlgorithm"].grid))))
    # Two criteria, two numbers of features of 64; unlimited depth, which holds all others; five folds.
    assert sorted(grown) == sorted((1000, c, f, None, 5) for c in ("gini", "entropy") for f in (8, 6))
