"""Every query of the library and its SQL, collected from the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import citations, collation, editions, lineage, listings, outlines, projects, readings, references, stemma, texts, variants, witnesses

_MODULES = (texts, collation, variants, projects, stemma, citations, lineage, references, editions, witnesses, readings, listings, outlines)
QUERIES = {name: f for m in _MODULES for name, f in m.registry.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.registry.sql.items()}


def entry(spark: SparkSession) -> DataFrame:
    """The table of readings of the smallest documents."""
    return collation.f21_variant_table(spark, "/root/testdata/sf0.001")
