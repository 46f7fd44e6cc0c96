"""Every sample gets a verdict."""

from cadenza import plans

SF = "/root/testdata/sf0.01"


def test_sample_gates_judges_every_event(spark):
    got = plans.QUERIES["sample_gates"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count() and got.where("i >= 50").count() > 0
