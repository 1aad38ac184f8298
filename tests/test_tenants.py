"""Views by tenant in two sessions."""

from pyspark.sql import functions as F

from sparkloom import tenants


def test_sessions_see_their_own_rows(spark, tmp_path):
    path = str(tmp_path / "notes")
    spark.range(90).select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant_id")).write.parquet(path)
    one, two, none = (spark.newSession() for _ in range(3))
    for session, tenant in ((one, "t0"), (two, "t1"), (none, None)):
        tenants.tenant_views(session, {"notes": path})
        tenants.set_tenant(session, tenant)
    seen = [{r["id"] for r in s.sql("select id from notes").collect()} for s in (one, two, none)]
    assert len(seen[0]) == len(seen[1]) == 30 and not seen[0] & seen[1] and not seen[2]
    assert one.sql("select count(*) n from notes a join notes b using (tenant_id)").first()["n"] == 900
    plan = one.sql("select id from notes where id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant_id,t0)" in plan
    tenants.set_tenant(one, "t' or '1' = '1")
    assert one.table("notes").count() == 0
    tenants.set_tenant(one, "t2")
    assert {r["tenant_id"] for r in one.table("notes").collect()} == {"t2"}


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "notes")
    spark.range(90).select("id", (F.col("id") % 3).cast("string").alias("tenant_id")).write.partitionBy("tenant_id").parquet(path)
    session = spark.newSession()
    tenants.tenant_views(session, {"notes": path})
    tenants.set_tenant(session, "1")
    df = session.table("notes")
    assert df.count() == 30 and "PartitionFilters: [isnotnull(tenant_id" in df._jdf.queryExecution().executedPlan().toString()
