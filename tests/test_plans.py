"""Chains read each table a few times, however many bands, folds and branches they have."""

import os
import re

import pytest

from terrapix.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def scans(df):
    """Scans and joins of the optimised plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"(?m)^[^\w]*(?:Relation|LogicalRDD|LocalRelation)\b", plan)), len(re.findall(r"\bJoin\b", plan))


@pytest.mark.parametrize(("name", "most"), [("radiometry", 4), ("bathymetry", 4), ("spatial_buffer_folds", 5)])
def test_scans(spark, name, most):
    found, joins = scans(QUERIES[name](spark, SF))
    assert 0 < found <= most and joins <= 6
