from catalogue import repairing


def test_the_drifted_table_is_damaged_once(spark):
    """The repaired table reads a stored one: no scan of it draws the damage again."""
    plan = repairing.repair_drifted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
