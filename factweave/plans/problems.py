"""Queries of the general data problems."""

from __future__ import annotations

from factweave.session import Scratch, table


def p4_found(spark, d):
    """Amounts of facts in the common unit of their dimension."""
    from factweave.operators.units import common_amounts

    return common_amounts(table(spark, d, "facts"), table(spark, d, "unit_factors"), Scratch(spark, "p4"))


def p4_sources(spark, d):
    """The unit that each way of recording amounts was found to mean, and by what."""
    from factweave.operators.units import amounts, source_units

    scratch = Scratch(spark, "p4")
    read = scratch.write(amounts(table(spark, d, "facts")))
    return source_units(read, table(spark, d, "unit_factors"), scratch).join(read.select("phrase").distinct(), "phrase", "left_semi")


def p7_found(spark, d):
    """Points in time of facts as microseconds UTC."""
    from factweave.operators.timestamps import instants

    return instants(table(spark, d, "facts"), table(spark, d, "document_files"))


def p7_zones(spark, d):
    """The zone whose offset history fits a document's undated stamps best."""
    from factweave.operators.timestamps import zone_estimates

    return zone_estimates(table(spark, d, "facts"), table(spark, d, "document_files"))


def p7_estimated(spark, d):
    """Points in time of facts, with the estimated zone where neither stamp nor document tells one."""
    from factweave.operators.timestamps import estimated_instants

    return estimated_instants(table(spark, d, "facts"), table(spark, d, "document_files"), Scratch(spark, "p7"))


def queries():
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
