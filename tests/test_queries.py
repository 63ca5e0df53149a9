"""Every registered query against its SQL check on the smallest tables."""

import oracle
import pytest
from textloom.plans import COVERAGE, ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


# Model fits without an SQL twin that the other tests do not already run.
@pytest.mark.parametrize("name", ["linear_threshold", "logistic_multinomial", "boosted_trees", "early_stop"])
def test_models_give_rates(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).collect()
    assert found
    for row in found:
        for value in row.asDict().values():
            assert not isinstance(value, float) or 0.0 <= value <= 3.0


def test_every_language_is_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    found = QUERIES["leave_one_domain_out"](spark, sf_dir).select("domain", "setting").collect()
    wanted = [(r.lang, setting) for r in docs.select("lang").distinct().collect() for setting in ("in_domain", "others")]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert all(COVERAGE[name] for name in QUERIES)
    assert not any(name.startswith(("op", "pipeline")) for name in QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
