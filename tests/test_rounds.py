"""Rounds over blocks with ghosts against the same rules hop by hop."""

import os

import pytest

from meshloom.operators import blocks, growth, labelling, rounds
from meshloom.sources import generators


@pytest.fixture(scope="module")
def graph(spark):
    """A grid of 5 x 5 x 5 cells that lacks some, with a shortcut, and three seeds; it has ties and theft."""
    cells = spark.range(125).where("id % 17 <> 3").selectExpr("id as e")
    edges = generators.lattice_edges(cells, 5).union(spark.createDataFrame([(0, 124), (60, 119)], "u long, v long")).cache()
    return cells.selectExpr("e as v"), edges, spark.createDataFrame([(1, 7), (62, 3), (123, 9)], "v long, label long")


def uneven(v):
    return v.selectExpr("v", "cast(pow(v / 125, 3) * 6 as long) as label")


RULES = {
    "noised": (lambda v, e, s: rounds.stealing_growth(e, s, "noised"), lambda v, e, s: growth.stealing_growth(e, s, "noised")),
    "ordered": (lambda v, e, s: rounds.stealing_growth(e, s, "ordered"), lambda v, e, s: growth.stealing_growth(e, s, "ordered")),
    "cut": (lambda v, e, s: rounds.cut_growth(e, s), lambda v, e, s: growth.stretch_growth(e, s, "cut")),
    "ranked": (lambda v, e, s: rounds.pagerank_labels(v, e, s), lambda v, e, s: labelling.pagerank_labels(v, e, s)),
    "majority": (lambda v, e, s: rounds.label_propagation(v, e, 5, ["v"]), lambda v, e, s: labelling.label_propagation(v, e, 5, ["v"])),
    "rebalanced": (lambda v, e, s: rounds.rebalanced(e, uneven(v), 3), lambda v, e, s: labelling.rebalance(e, uneven(v), 6, 3)),
    "covered": (lambda v, e, s: rounds.pagerank_labels(v, e, s, 1e8, 1.2, 2), lambda v, e, s: labelling.pagerank_labels(v, e, s, 1e8, 1.2, 2)),
}


@pytest.mark.parametrize("name", RULES)
def test_rounds_over_blocks_equal_hops(graph, monkeypatch, name):
    monkeypatch.setattr(blocks, "block_count", lambda edges: 4)
    packed, hops = (sorted(map(tuple, f(*graph).collect()), key=lambda r: r[0]) for f in RULES[name])
    assert packed == hops and len(packed) > 100


def test_a_job_runs_as_many_rounds_as_ghosts_are_deep(spark, monkeypatch):
    """A path of 400 vertices takes 400 rounds of growth from its end."""
    monkeypatch.setattr(blocks, "block_count", lambda edges: 3)
    edges, root = spark.range(399).selectExpr("id as u", "id + 1 as v"), spark.conf.get("spark.checkpoint.dir")
    jobs = lambda: sum(n.startswith("rounds-") for n in os.listdir(f"{root}/meshloom"))
    os.makedirs(f"{root}/meshloom", exist_ok=True)
    before = jobs()
    grown = rounds.stealing_growth(edges, spark.createDataFrame([(0, 0)], "v long, label long"), "noised")
    assert sorted(r["dist"] for r in grown.collect()) == list(range(400))
    assert jobs() - before <= 400 / rounds.DEPTH + 4
