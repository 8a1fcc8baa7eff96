"""Random orders are sorted only where a budget ends; the ends are those of the whole order."""

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from shoalcount.operators import prioritization as pr


def test_budget_ends_are_those_of_the_sorted_order(spark):
    costs = {(c, t): Decimal(3 + (c * 7 + t * 5) % 11) for c in range(6) for t in range(150)}
    items = spark.createDataFrame([(c, t, v) for (c, t), v in costs.items()], "clip_id long, track_id long, cost_s decimal(18,6)")
    budgets, total = (0.0, 0.01, 0.5, 0.97, 1.0), sum(costs.values())
    want = {}
    for r in range(7):
        cum = Decimal(0)
        for h, c, t in sorted((int(hashlib.md5(f"0:{r}:{c}:{t}".encode()).hexdigest()[:8], 16), c, t) for c, t in costs):
            cum += costs[c, t]
            want |= {(r, b): (h, c, t) for b in budgets if cum <= Decimal(str(b)) * total}
    last = pr._budget_ends(items, items.agg(F.sum("cost_s").alias("total_cost")), budgets, 7, 0).collect()
    assert {(x["r"], float(x["budget"])): tuple(x["last"]) for x in last} == want and (0, 0.0) not in want
