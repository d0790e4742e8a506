"""Source rules that keep the operators distributed."""

import pathlib
import re

import pytest

SOURCES = sorted(pathlib.Path(__file__).parent.parent.joinpath("tallyforge").rglob("*.py"))
# Modules that bring rows to the driver, and how often: statistics of columns, classes, clusters,
# slices, pivots, tree nodes; a file's head.
COLLECTS = {
    "flows.py": 1, "metrics.py": 1, "counts.py": 1, "silhouette.py": 2, "clustering.py": 3, "splits.py": 3, "learners.py": 1,
    "quantiles.py": 1, "prepare.py": 1, "roles.py": 1, "nearest.py": 3, "ordering.py": 1, "segments.py": 2, "delimited.py": 1,
    "boosting.py": 2, "persistence.py": 1,
    "tube.py": 1,  # width + 3 rows of sums
}
OPERATORS = [p for p in SOURCES if "catalog" not in p.parts]


@pytest.mark.parametrize("pattern", [
    r"localCheckpoint", r"crossJoin", r"\.rdd\b", r"F\.udf\(", r"\.limit\(\d+\)\.toPandas", r"monotonically_increasing_id"])
def test_not_used(pattern):
    hits = [f"{p.name}: {m.group()}" for p in SOURCES for m in re.finditer(pattern, p.read_text())]
    assert hits == []


def test_whole_tables_are_not_pulled_to_the_driver():
    # the only pandas result is the node table of a forest, bounded by trees and subsample
    hits = [p.name for p in OPERATORS if "toPandas" in p.read_text()]
    assert hits == ["isolation.py"]


def test_queries_run_over_whole_tables():
    catalog = [p for p in SOURCES if "catalog" in p.parts]
    for p in catalog:
        assert not re.search(r"\.sample\(|TABLESAMPLE|randomSplit", p.read_text()), p.name


def test_collects_are_the_known_ones():
    found = {}
    for p in OPERATORS:
        if "llm" not in p.parts and (n := p.read_text().count(".collect()")):
            found[p.name] = n
    assert found == COLLECTS
