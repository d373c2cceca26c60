"""The bucketed store: what a merge gives, and what it shuffles."""

import re

from vellumflow.operators.bucketed import BucketedStore

SCHEMA = "k long, v string, w int"


def test_merges_shuffle_the_batch_only(spark):
    held = spark.createDataFrame([(i, f"a{i}", i) for i in range(500)] + [(None, "null", 1)], SCHEMA)
    store = BucketedStore(spark, held, "k", 4)
    want = {i: (f"a{i}", i) for i in range(500)}
    for turn in range(3):
        rows = [(i, f"b{turn}", None) for i in range(turn * 100, 700, 7)] + [(None, f"null {turn}", 2)]
        batch = spark.createDataFrame(rows, SCHEMA)
        merged = store.merged(batch)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "SelectedBucketsCount: 4 out of 4" in plan
        store.merge(batch)
        want |= {k: (v, w) for k, v, w in rows if k is not None}
        got = store.rows.collect()
        assert {r.k: (r.v, r.w) for r in got if r.k is not None} == want and len(got) == len(want) + 2 + turn
        assert sorted(r.v for r in got if r.k is None) == sorted(["null", *(f"null {t}" for t in range(turn + 1))])
        # One sorted file for each bucket, generation after generation.
        assert len({f.rpartition("/")[2] for f in store.rows.inputFiles()}) == 4
