"""Tables that a session sees its own tenant's rows of, and no others.

Views are filtered by a session variable, which is a constant by the time a query
is planned, so that the filter reaches the files. A session without a tenant sees
no rows. Names of the tables themselves aren't given to the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

VARIABLE = "tenant_of_session"


def tenant_views(spark: SparkSession, tables: dict[str, str], column: str = "tenant_id") -> None:
    """A view for each name over a Parquet folder, filtered by the session's tenant; the session starts without one."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    for name, path in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM parquet.`{path}` WHERE `{column}` = {VARIABLE}")


def set_tenant(spark: SparkSession, tenant: str | None) -> None:
    """Whose rows the session's views show from now on."""
    spark.sql(f"SET VARIABLE {VARIABLE} = CAST(:tenant AS STRING)", args={"tenant": tenant})
