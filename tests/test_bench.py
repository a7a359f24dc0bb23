"""The headline queries."""

import bench
from checks.queries import QUERIES


def test_training_is_benched():
    assert {"tree_models", "train_linear"} <= set(bench.HEADLINE) <= QUERIES.keys()
