"""Every registered query keeps its own name."""

import pytest

from emberline import registry
from emberline.plans import catalog


def test_a_name_is_registered_once():
    assert {"str_04_survivor_order", "str_04_survivor_by_key", "add_47_worst_of", "add_47_worst_of_account"} <= set(registry.queries())
    with pytest.raises(ValueError):
        catalog.both("add_47_worst_of", "SELECT 1")
    with pytest.raises(ValueError):
        catalog.query("add_47_worst_of")(lambda spark, sf_dir: None)
