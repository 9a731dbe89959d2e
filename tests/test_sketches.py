import datetime as dt
import random

from tallyloom.operators import sketches

COLUMNS = "kind string, at timestamp, who long, value double"


def rows_of(seed, days):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(2)}", dt.datetime(2024, 1, 1 + rng.randrange(days), rng.randrange(24)), rng.randrange(3000), rng.gauss(0, 1)) for _ in range(8000)]


def test_ranges_against_exact(spark):
    rows = rows_of(1, 9)
    days = sketches.daily(spark.createDataFrame(rows, COLUMNS), ["kind"], "at", "who", "value")
    for first, last in ((1, 9), (3, 5), (4, 4)):
        part = days.where(f"day(day) between {first} and {last}")
        for r in sketches.estimates(sketches.merged(part, ["kind"]), 0.1, 0.5).collect():
            own = [x for x in rows if x[0] == r.kind and first <= x[1].day <= last]
            users = len({x[2] for x in own})
            assert r.rows == r.n == len(own) and abs(r.distinct - users) <= 0.08 * users + 1
            for share, value in zip((0.1, 0.5), r.quantiles):
                assert abs(sum(x[3] <= value for x in own) / len(own) - share) <= 0.03


def test_a_day_written_again_changes_only_itself(spark):
    rows = rows_of(2, 3)
    days = sketches.daily(spark.createDataFrame(rows, COLUMNS), ["kind"], "at", "who", "value")
    again = sketches.daily(spark.createDataFrame([x for x in rows if x[1].day == 2][:100], COLUMNS), ["kind"], "at", "who", "value")
    put = days.where("day(day) <> 2").unionByName(again)
    assert sketches.merged(put, []).first()["rows"] == sum(x[1].day != 2 for x in rows) + 100


def test_odd_rows(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(None, day, None, None), ("a", day, 1, float("nan")), ("a", None, 2, 1.0), ("b", day, 1, float("inf")), ("b", day, 1, float("inf"))]
    days = sketches.daily(spark.createDataFrame(rows, COLUMNS), ["kind"], "at", "who", "value")
    found = {r.kind: (r.rows, r.distinct, r.n, r.quantiles) for r in sketches.estimates(sketches.merged(days, ["kind"]), 0.5).collect()}
    assert found == {None: (1, 0, 0, [None]), "a": (1, 1, 0, [None]), "b": (2, 1, 2, [float("inf")])}
    empty = sketches.daily(spark.createDataFrame([], COLUMNS), ["kind"], "at", "who", "value")
    assert sketches.estimates(sketches.merged(empty, ["kind"]), 0.5).count() == 0
