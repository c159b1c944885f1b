"""On the load with faults every rule of every kind has to be broken somewhere."""

import pytest

from binledger import schemas
from binledger.operators import integrity
from binledger.plans import catalog
from binledger.sources.testdata import FaultyTables

RULES = {
    "primary": lambda: {f"PK {t}" for t in schemas.PRIMARY_KEY},
    "unique": lambda: {f"UQ {t}" for t in schemas.UNIQUE_KEY},
    "references": lambda: {f"FK {t}.{c}" for t, refs in schemas.FOREIGN_KEYS.items() for c, _ in refs},
    "database": lambda: {r.rule_id for r in schemas.check_rules("database")},
    "application": lambda: {r.rule_id for r in schemas.check_rules("application")},
    "required": lambda: {f"NN {t}.{c}" for t in schemas.TABLE_DDL for c in schemas.required_columns(t)},
}
BROKEN = {
    "primary": integrity.primary_key_violations,
    "unique": integrity.unique_key_violations,
    "references": integrity.foreign_key_violations,
    "database": integrity.check_violations,
    "application": lambda t: integrity.check_violations(t, "application"),
    "required": integrity.not_null_violations,
}


@pytest.mark.parametrize("kind", RULES)
def test_every_rule_fires(spark, sf_dir, kind):
    found = BROKEN[kind](FaultyTables(spark, sf_dir)).select("rule_id").distinct().collect()
    assert {r.rule_id for r in found} == RULES[kind]()


def test_nothing_dangles_on_the_derived_tables(spark, derived):
    none = integrity.foreign_key_violations(derived, ["product", "employee"])
    assert none.isEmpty() and none.columns == ["rule_id", "table_name", "row_key", "value"]


def test_keys_are_tested_table_by_table(spark, seeded):
    """What breaks a key is written per table, so the result shuffles nothing."""
    twice = {**seeded, "supplier": seeded["supplier"].unionAll(seeded["supplier"])}
    found = integrity.primary_key_violations(twice)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.table_name, r.n_rows) for r in found.collect()} == {("supplier", 2)}
    assert found.count() == seeded["supplier"].count()


def test_chain_in_halves_reads_a_written_log(derived):
    plan = catalog._chain_in_halves(derived)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "transaction_id" in plan
