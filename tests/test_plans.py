"""Every registered query can be planned: names, columns and types resolve on the small tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from maskloom.plans import catalog

SF = "/root/testdata/sf0.001"
#: These fit models while they are built; test_models.py, test_tagger.py and the queries' own runs cover them.
FITTED = {"c14_fitted_model", "g5_second_stage_model", "g6_url_model"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_every_query_plans(spark):
    def fault(name):
        try:
            return None if catalog.QUERIES[name](spark, SF).schema.fields else "no columns"
        except Exception as e:  # noqa: BLE001
            return f"{name}: {e!r}"[:300]

    with ThreadPoolExecutor(8) as pool:
        faults = [f for f in pool.map(fault, sorted(set(catalog.QUERIES) - FITTED)) if f]
    assert not faults
