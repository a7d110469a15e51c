import random

from hushframe.operators import intervals


def test_intervals_of_all_lengths_meet_once(spark):
    rng = random.Random(3)
    made = lambda n: [(rng.randrange(3), k, a, a + rng.choice([0, 1, 5, 40, 900, 10**9])) for k in range(n) for a in [rng.randrange(0, 3000)]]
    left, right = made(120), made(90)
    a = spark.createDataFrame(left, "key long, a_id long, a_from long, a_to long")
    b = spark.createDataFrame(right, "key long, b_id long, b_from long, b_to long")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[3] > y[2] and x[2] < y[3])
    options = {"bucket": 10, "left_span": ("a_from", "a_to"), "right_span": ("b_from", "b_to")}
    got = intervals.overlap_join(a, b, "key", **options)
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == want and len(want) > 500
    kept = intervals.overlap_join(a, b, "key", keep=["key", "a_id"], **options)
    assert {r["a_id"] for r in kept.collect()} == set(range(120))
    assert intervals.overlap_join(a.limit(0), b, "key", **options).count() == intervals.overlap_join(a, b.limit(0), "key", **options).count() == 0
