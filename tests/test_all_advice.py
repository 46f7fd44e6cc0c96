"""All rules of the advice give rows."""

from cadenza import plans
from cadenza.plans.scoring import ALL_RULES

SF = "/root/testdata/sf0.01"


def test_all_advice_gives_every_rule(spark):
    got = plans.QUERIES["all_advice"](spark, SF).groupBy("id").count().collect()
    assert len(ALL_RULES) == 17 and {r.id for r in got} == {r[0] for r in ALL_RULES}
