"""All queries of the core, and their SQL."""

from __future__ import annotations

from factweave.plans import problems, reading, reference  # noqa: F401  (reading adds its queries to those of reference)


def flagship(spark, sf_dir):
    return queries()["reconcile_orders"](spark, sf_dir)


def queries():
    return reference.QUERIES | problems.queries()


def oracle_sql():
    return dict(reference.SQL)
