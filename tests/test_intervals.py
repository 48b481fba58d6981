"""Dyadic buckets against plain comparisons of ranges."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, occasions, sessions


def test_blocks_cover_each_number_once(spark):
    rng = random.Random(1)
    ranges = [(a, a + rng.choice([0, 1, 2, 7, 100, 10_957, -1])) for a in (rng.randint(-40_000, 40_000) for _ in range(200))]
    ranges += [(-3_000_000, 3_000_000), (0, 1 << 24), (5, 4)]
    df = spark.createDataFrame(ranges, "low long, high long").withColumn("b", intervals.range_blocks(F.col("low"), F.col("high")))
    for r in df.collect():
        spans = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r["b"])
        size = max(0, r["high"] - r["low"] + 1)
        assert sum(e - s for s, e in spans) == size
        assert not spans or (spans[0][0], spans[-1][1]) == (r["low"], r["high"] + 1)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= max(1, 2 * size.bit_length()) and (size != 10_958 or len(spans) < 30)


@pytest.mark.parametrize("by", [[], ["who"]])
def test_points_in_ranges(spark, by):
    rng = random.Random(2)
    points = [(i, rng.choice(["a", "b", None]), rng.randint(-50, 400)) for i in range(150)]
    ranges = [(i, rng.choice(["a", "b", None]), s, s + rng.choice([-3, 0, 1, 5, 40, 300])) for i, s in enumerate(rng.randint(-60, 400) for _ in range(60))]
    p = spark.createDataFrame(points, "id long, who string, x long")
    r = spark.createDataFrame(ranges, "rid long, who string, low long, high long")
    r = r if by else r.withColumnRenamed("who", "other")
    got = intervals.points_in_ranges(p, F.col("x"), r, F.col("low"), F.col("high"), by).select("id", "rid").collect()
    want = [(i, k) for i, w, x in points for k, o, s, e in ranges if s <= x <= e and (not by or w == o)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_only_used_levels_are_looked_up(spark):
    blocks = intervals.blocked_ranges(spark.createDataFrame([(8, 8), (17, 17)], "low long, high long"), F.col("low"), F.col("high"))
    assert intervals.used_levels(blocks) == [0]


def test_overlapping_ranges(spark):
    rng = random.Random(3)
    start = date(2019, 12, 1)

    def some(n, lengths):
        return [(i, s, s + timedelta(days=rng.choice(lengths))) for i, s in enumerate(start + timedelta(days=rng.randrange(900)) for _ in range(n))]

    left, right = some(70, [0, 0, 1, 4, 700, -2]), some(50, [0, 3, 9, 60, -1]) + [(99, None, start)]
    a = spark.createDataFrame(left, "a long, s date, e date")
    b = spark.createDataFrame(right, "b long, t date, f date")
    got = occasions.overlaps(a, b, ("s", "e"), ("t", "f")).select("a", "b").collect()
    want = [(i, j) for i, s, e in left for j, t, f in right if t and s <= e and t <= f and s <= f and t <= e]
    assert sorted(map(tuple, got)) == sorted(want)


def test_any_occasion_is_every_occasion(spark):
    """The ranges that some date falls into are those with hits, however many people share a date."""
    rng = random.Random(4)
    start = date(2019, 1, 1)
    ranges = [(i, s, s + timedelta(days=rng.choice([0, 1, 2, 30]))) for i, s in enumerate(start + timedelta(days=rng.randrange(2200)) for _ in range(120))]
    ranges += [(500, date(2021, 2, 28), date(2021, 2, 28)), (501, date(2020, 2, 28), date(2020, 2, 28)), (502, date(2020, 2, 29), date(2020, 3, 1))]
    recurring = [(f"p{i}", *rng.choice([(2, 29), (7, 4), (12, 31), (4, 31), (1, 1)]), rng.choice([None, 2021, 2023, 0])) for i in range(40)]
    fests = [(1, "holi", 2020, date(2020, 3, 10), date(2020, 3, 9), date(2020, 3, 11))]
    r = spark.createDataFrame(ranges, "event_id long, start_date date, end_date date")
    c = spark.createDataFrame(recurring, "key string, month int, day int, first_year int").select(
        "*", F.lit("birthday").alias("kind"), F.col("key").alias("name"), F.lit(1).cast("bigint").alias("person_id"),
        F.struct(F.lit(0).alias("source"), F.lit(1).cast("bigint").alias("id")).alias("listed"),
    )
    f = spark.createDataFrame(fests, "id long, festival string, year int, date date, start date, end date")
    hits = occasions.occasion_hits(r, f, c).select("event_id", "key", "date").collect()
    want = [(9, "holi", None)][:0]
    for i, s, e in ranges:
        want += [(i, "holi", d[3]) for d in fests if d[4] <= e and s <= d[5]]
        for n in range((e - s).days + 1):
            d = s + timedelta(days=n)
            last = (date(d.year, 3, 1) - timedelta(days=1)).day
            for key, month, day, first in recurring:
                day = min(day, last) if (month, day) == (2, 29) else day
                if (d.month, d.day) == (month, day) and (not first or d.year >= first):
                    want.append((i, key, d))
    assert sorted(map(tuple, hits)) == sorted(want)
    assert sorted(x[0] for x in occasions.on_any_occasion(r, f, c).collect()) == sorted({x[0] for x in want})


def test_ranges_of_the_same_days_meet_dates_once(spark, monkeypatch):
    """Whatever the number of ranges, as many meet the dates as differ in their days."""
    met, join = [], intervals.points_in_ranges

    def counted(points, point, ranges, *rest):
        met.append(max(points.count(), ranges.count()))
        return join(points, point, ranges, *rest)

    monkeypatch.setattr(occasions, "points_in_ranges", counted)
    rows = [(i, date(2020, 1, 1 + i % 5), date(2020, 1, 1 + i % 5 + i % 2)) for i in range(600)]
    r = spark.createDataFrame([*rows, (600, None, None)], "event_id long, start_date date, end_date date")
    c = spark.createDataFrame([(1, 2, 2019), (1, 4, 2021)], "month int, day int, first_year int")
    f = spark.createDataFrame([(date(2020, 1, 5), date(2020, 1, 7))], "start date, end date")
    got = occasions.on_any_occasion(r, f, c).collect()
    assert sorted(x[0] for x in got) == [i for i, s, e in rows if s <= date(2020, 1, 2) <= e or e >= date(2020, 1, 5)]
    assert max(met) <= 11


def test_first_windows(spark):
    """Stretches do not overlap and hold the first window of every moment."""
    rng = random.Random(5)
    t = datetime(2020, 12, 30)
    windows = [(i, s, s + timedelta(minutes=rng.choice([0, 30, 600, 9000, -5]))) for i, s in enumerate(t + timedelta(minutes=30 * rng.randrange(300)) for _ in range(40))]
    got = sessions.first_windows(spark.createDataFrame(windows, "event_id long, start_at timestamp, end_at timestamp")).collect()
    moments = [t + timedelta(minutes=15 * k) for k in range(-2, 1400)]
    for at in moments:
        fits = sorted((s, e, w) for w, s, e in windows if s <= at <= e)
        assert [r["event_id"] for r in got if r["start_at"] <= at < r["until"]] == [x[2] for x in fits[:1]]


@pytest.mark.parametrize("seed", range(3))
def test_late_rows_repair_sessions(spark, seed):
    """Late rows join, extend and bridge stored sessions as if all rows had been there; owners may be null."""
    rng = random.Random(seed)
    t = datetime(2023, 12, 30)
    rows = [(rng.choice(["a", "b", None]), t + timedelta(minutes=10 * rng.randrange(3000))) for _ in range(160)]
    rows += [("a", t + timedelta(hours=6 * k)) for k in range(4)]
    late = [r for r in rows if rng.random() < 0.3] or rows[:1]
    early = list(rows)
    for r in late:
        early.remove(r)
    schema = "who string, taken_at timestamp_ntz"
    stored = sessions.session_spans(spark.createDataFrame(early, schema), 6, ["who"])
    got = sessions.repair_spans(stored, spark.createDataFrame(late, schema), 6, ["who"])
    want = sessions.session_spans(spark.createDataFrame(rows, schema), 6, ["who"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_untouched_sessions_stay(spark):
    """Sessions beyond the gap of every late row are handed on as they are stored."""
    t = datetime(2023, 1, 1)
    stored = spark.createDataFrame([("a", t, t, 7), ("a", t + timedelta(hours=13), t + timedelta(hours=14), 9)], "who string, start_at timestamp_ntz, end_at timestamp_ntz, n long")
    late = spark.createDataFrame([("a", t + timedelta(hours=6)), ("b", t + timedelta(hours=14))], "who string, taken_at timestamp_ntz")
    got = sorted(map(tuple, sessions.repair_spans(stored, late, 6, ["who"]).collect()))
    assert got == [("a", t, t + timedelta(hours=6), 8), ("a", t + timedelta(hours=13), t + timedelta(hours=14), 9), ("b", t + timedelta(hours=14), t + timedelta(hours=14), 1)]
