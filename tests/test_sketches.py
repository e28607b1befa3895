"""Windows from daily sketches against all their rows."""

import random

from pyspark.sql import functions as F

from demandlens.operators import sketches


def test_quantiles_of_a_window_are_within_the_stated_error(spark):
    rng = random.Random(2)
    rows = [(("hot" if rng.random() < 0.7 else "cold"), rng.lognormvariate(0, 2), f"2024-01-{rng.randint(1, 28):02d} 10:00:00") for _ in range(30_000)]
    rows += [("hot", None, "2024-01-03 00:00:00"), ("hot", 1e9, None), ("one", 5.0, "2024-01-05 00:00:00")]
    log = spark.createDataFrame(rows, "host string, seconds double, at string").withColumn("at", F.col("at").cast("timestamp"))
    daily = sketches.daily_quantiles(log, "host", "seconds", "at")
    at = {f"p{q}": q / 100 for q in (1, 25, 50, 90, 99)}
    for start, end in ((None, None), ("2024-01-05", "2024-01-12")):
        inside = [r for r in rows if r[1] is not None and r[2] is not None and (start is None or start <= r[2][:10] < end)]
        for r in sketches.quantiles(daily, "host", at, start, end).collect():
            own = sorted(x for h, x, _ in inside if h == r.host)
            assert (r.n, r.least, r.most) == (len(own), own[0], own[-1])
            for name, q in at.items():
                assert abs(sum(x <= r[name] for x in own) / len(own) - q) <= sketches.rank_error() + 1 / len(own)
    assert daily.where("host = 'hot'").count() == 28


def test_a_union_of_days_is_near_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), int(rng.paretovariate(0.3)) % 9000, f"2024-02-{rng.randint(1, 20):02d}", rng.choice(["required", "mentioned"])) for _ in range(20_000)] + [(None, 1, "2024-02-01", "x"), (1, None, "2024-02-02", "required")]
    df = spark.createDataFrame(rows, "skill_id int, posting_id long, seen string, importance string").withColumn("seen", F.col("seen").cast("date"))
    required = {"required": F.col("importance") == "required"}
    window = sketches.distinct_counts(sketches.daily_distinct(df, "skill_id", "posting_id", "seen", required), "skill_id", "2024-02-04", "2024-02-15")
    inside = df.where("seen >= '2024-02-04' AND seen < '2024-02-15' AND skill_id IS NOT NULL")
    whole = inside.groupBy("skill_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg("posting_id", sketches.LG_K)).alias("distinct"), F.hll_sketch_estimate(F.hll_sketch_agg(F.when(required["required"], F.col("posting_id")), sketches.LG_K)).alias("required"))
    exact = {r.skill_id: r for r in inside.groupBy("skill_id").agg(F.countDistinct("posting_id").alias("distinct"), F.count(F.lit(1)).alias("n"), F.count_if(required["required"]).alias("n_required")).collect()}
    one_pass = {r.skill_id: (r.distinct, r.required) for r in whole.collect()}
    for r in window.collect():
        # the same registers, but a sketch that is no union is estimated in another way
        assert all(abs(x - y) <= 2 * sketches.relative_error() * y for x, y in zip((r.distinct, r.required), one_pass[r.skill_id]))
        assert (r.n, r.n_required) == (exact[r.skill_id].n, exact[r.skill_id].n_required)
        assert abs(r.distinct - exact[r.skill_id].distinct) <= 4 * sketches.relative_error() * exact[r.skill_id].distinct
