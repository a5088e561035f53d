import random

from prismal.operators import resample as R


def greedy(sizes, share):
    room, out = (1 - share) * sum(sizes.values()), {}
    for k, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or "")):
        out[k] = "train" if n <= room else "test"
        room -= n * (n <= room)
    return out


def test_split_equals_the_fill_set_by_set(spark):
    draw = random.Random(1)
    for share, top in ((0.2, 6), (0.37, 40), (0.5, 1)):
        sizes = {k: draw.randrange(1, top + 1) for k in [None, *(f"s{i}" for i in range(120))]}
        rows = [(k,) for k, n in sizes.items() for _ in range(n)]
        draw.shuffle(rows)
        got = {r.key: r.split for r in R.set_split(spark.createDataFrame(rows, "key string").repartition(5), "key", share).collect()}
        assert got == greedy(sizes, share)
    assert R.set_split(spark.createDataFrame([], "key string"), "key").count() == 0


def test_numbers_within_a_key_come_from_ranges(spark):
    rows = [(i % 2, f"k{i * 37 % 500:03d}") for i in range(500)]
    out = R.in_order(spark.createDataFrame(rows, "g int, k string"), "g", "k", "at")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line and "row_number" in line)
    for g in (0, 1):
        want = sorted(k for h, k in rows if h == g)
        assert [r.k for r in sorted(out.filter(f"g = {g}").collect(), key=lambda r: r["at"])] == want
