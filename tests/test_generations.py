"""Generation numbers of the whole commit graph against brute force."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_commit_has_its_generation(spark, sf):
    keys = sorted(r.o_orderkey for r in spark.read.parquet(f"/root/testdata/{sf}/orders.parquet").select("o_orderkey").distinct().collect())
    want = {}
    for k in keys:  # parents are smaller
        parents = ([k // 2] if k > 0 else []) + ([k // 3] if k % 5 == 0 and k > 2 else [])
        want[k] = 1 + max((want[p] for p in parents if p in want), default=0)
    got = __spark_entry__.queries()["all_generation_numbers"](spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(want) > 1000 and {int(r.sha): r.gen for r in got} == want
