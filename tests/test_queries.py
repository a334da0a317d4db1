"""Every registered query of the library against its SQL over the smallest tables."""

import compare
import pytest

from auditloom.plans import registry
from auditloom.plans.oracles import ORACLES
from auditloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries over audits; these are audited once for all of them, and a few run as they are registered.
AUDITS = {prefix + name for prefix in ("", "made_up_") for name in registry._AUDIT}
WHOLE = {"premium_scorecard", "made_up_findings_all"}


@pytest.fixture(scope="module")
def audited(spark):
    return {"": registry._audits(spark, SF).persist(), "made_up_": registry._made_up(spark, SF).persist()}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - AUDITS | WHOLE))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert not compare.differences(found, compare.database(SF), ORACLES[name])
    else:
        assert found.count() > 0


@pytest.mark.parametrize("name", sorted(AUDITS - WHOLE))
def test_query_over_audits(spark, audited, name):
    prefix = "made_up_" if name.startswith("made_up_") else ""
    found = registry._AUDIT[name.removeprefix(prefix)](audited[prefix])
    assert not compare.differences(found, compare.database(SF), ORACLES[name])


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
