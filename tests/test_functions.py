import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import dates, numeric, text


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def moments(n, seed):
    """Random instants of this century, and a few awkward ones."""
    rng = random.Random(seed)
    out = [datetime(2001, 1, 1) + timedelta(seconds=rng.randrange(24 * 365 * 86400)) for _ in range(n)]
    return [*out, datetime(2016, 2, 29, 0, 0, 0), datetime(2007, 12, 31, 23, 59, 59), datetime(2012, 6, 5, 12, 30, 0)]


# each way of naming a file, and whether it has the time of day
STYLES = [
    (lambda t: f"IMG-{t:%Y%m%d}-WA{t.second:04d}.jpg", False),
    (lambda t: f"VID-{t:%Y%m%d}-WA0{t.second:03d}.mp4", False),
    (lambda t: f"IMG_{t:%Y%m%d_%H%M%S}.jpg", True),
    (lambda t: f"PXL_{t:%Y%m%d_%H%M%S}{t.minute:03d}.jpg", True),
    (lambda t: f"{t:%Y%m%d_%H%M%S}_edited.png", True),
    (lambda t: f"Screenshot_{t:%Y-%m-%d-%H-%M-%S}.png", True),
    (lambda t: f"WhatsApp Image {t:%Y-%m-%d} at {t:%H.%M.%S}.jpeg", True),
    (lambda t: f"whatsapp video {t:%Y-%m-%d} at {t.hour % 12 or 12}.{t:%M.%S} {'AM' if t.hour < 12 else 'PM'} (2).mp4", True),
    (lambda t: f"harvest {t:%Y-%m-%d} at home.jpg", False),
    (lambda t: f"album {t:%Y%m%d}.jpg", False),
]


def test_dates_from_names(spark):
    cases = [(name(t), t if timed else datetime(t.year, t.month, t.day)) for t in moments(12, 3) for name, timed in STYLES]
    assert column(spark, [n for n, _ in cases], "string", dates.date_from_name) == [d for _, d in cases]


def test_names_without_a_date(spark):
    none = ["", "lake.jpg", "DSC_7731.jpg", None]
    for y, m, d in ((2018, 13, 4), (2018, 0, 9), (2018, 6, 31), (2018, 2, 29), (2018, 9, 0), (1643, 5, 6), (8080, 5, 6)):
        none += [f"IMG_{y:04d}{m:02d}{d:02d}_081500.jpg", f"album {y:04d}{m:02d}{d:02d}.jpg"]
    assert column(spark, none, "string", dates.date_from_name) == [None] * len(none)
    # an impossible time of day leaves the day
    late = [f"IMG_20180704_{x}.jpg" for x in ("240000", "076100", "071560")]
    assert column(spark, late, "string", dates.date_from_name) == [datetime(2018, 7, 4)] * 3


def test_embedded_dates(spark):
    good = [(w(t), t) for t in moments(8, 5) for w in (
        lambda t: f"{t:%Y:%m:%d %H:%M:%S}", lambda t: f"{t:%Y-%m-%dT%H:%M:%S}", lambda t: f"{t:%Y:%m:%d %H:%M:%S}\x00\x00", lambda t: f"{t:%Y:%m:%d %H:%M:%S}-03:00",
    )]
    bad = ["", " ", ":" * 6, "0000:00:00 00:00:00", "2018:06:31 08:15:00", "2018:13:01 08:15:00", "1969:12:31 23:59:59", "2750:03:04 05:06:07", "yesterday"]
    assert column(spark, [x for x, _ in good] + bad, "string", dates.parse_exif) == [t for _, t in good] + [None] * len(bad)


def test_priority(spark):
    """The first usable of tag, container, name and file time wins."""
    tag, box, named, file = moments(4, 8)[:4]
    rows = []
    for mask in range(8):
        rows.append((mask, f"IMG_{named:%Y%m%d_%H%M%S}.jpg" if mask & 4 else "lake.jpg", (file - datetime(1970, 1, 1)).total_seconds() + 0.999999,
                     f"{tag:%Y:%m:%d %H:%M:%S}" if mask & 1 else "unset", box if mask & 2 else datetime(1904, 1, 1)))
    df = spark.createDataFrame(rows, "id int, name string, mtime double, exif string, video timestamp_ntz")
    r = dates.resolve_date(F.col("name"), F.col("mtime"), F.col("exif"), F.col("video"))
    got = [tuple(x["r"]) for x in df.select("id", r.alias("r")).orderBy("id").collect()]
    want = [
        (tag, "exif", "high") if m & 1 else (box, "video_meta", "high") if m & 2 else (named, "filename", "medium") if m & 4 else (file, "mtime", "low")
        for m in range(8)
    ]
    assert got == want


def age_text(birth, day):
    """The label by counting whole months on a calendar."""
    if birth is None:
        return None
    if day < birth:
        return "Before birth"
    months = (day.year - birth.year) * 12 + day.month - birth.month - (day.day < birth.day)
    if months == 0:
        days = (day - birth).days
        return "Newborn" if days == 0 else f"{days} day" + "s" * (days > 1)
    years, months = divmod(months, 12)
    parts = [f"{years} yr" + "s" * (years > 1)] if years else []
    if months and years < 18:
        parts.append(f"{months} mo" + "s" * (months > 1))
    return " ".join(parts)


def test_ages(spark):
    births = [date(2011, 8, 31), date(2012, 2, 29), date(2003, 4, 30), None]
    days = [timedelta(days=d) for d in (-40, 0, 1, 2, 27, 29, 30, 31, 59, 61, 364, 365, 366, 367, 1095, 1461, 2000)]
    cases = [(b, (b or date(2011, 1, 1)) + d) for b in births for d in days]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b date, d date")
    got = [r["r"] for r in rows.select("i", dates.age_label(F.col("b"), F.col("d")).alias("r")).orderBy("i").collect()]
    assert got == [age_text(*c) for c in cases]


def test_chapter_ages(spark):
    rows = spark.createDataFrame(
        [(1, date(1972, 11, 2), date(1979, 11, 1), date(1993, 11, 2)), (2, date(1972, 11, 2), date(2005, 4, 9), None), (3, None, date(2005, 4, 9), None)],
        "i int, b date, s date, e date",
    )
    got = rows.select("i", dates.chapter_age(F.col("b"), F.col("s"), F.col("e")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == ["Age 6 – 21", "From age 32", None]


def test_ordinals_and_leap_days(spark):
    numbers = list(range(1, 130))
    ends = {1: "st", 2: "nd", 3: "rd"}
    want = [f"{n}{'th' if n % 100 in (11, 12, 13) else ends.get(n % 10, 'th')}" for n in numbers]
    assert column(spark, numbers, "int", text.ordinal) == want
    years = list(range(2095, 2106))
    last = [date(y, 3, 1) - timedelta(days=1) for y in years]
    assert column(spark, years, "int", lambda y: dates.on_year(F.lit(2), F.lit(29), y)) == last
    assert column(spark, [y - 2096 for y in years[1:]], "int", lambda n: dates.add_years(F.lit(date(2096, 2, 29)), n)) == last[1:]


def test_signatures(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(20)] + [(1 << 63, 0), (0, (1 << 64) - 1)]
    rows = spark.createDataFrame([(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a, b in pairs], "a string, b string, d int")
    d = numeric.hamming(numeric.hex_to_signature(F.col("a")), numeric.hex_to_signature(F.col("b")))
    assert all(r["r"] == r["d"] for r in rows.select(d.alias("r"), "d").collect())
    back = numeric.signature_to_hex(numeric.hex_to_signature(F.col("b")))
    assert all(r["r"] == r["b"] for r in rows.select(back.alias("r"), "b").collect())


def test_quality_total(spark):
    """The weighted mean of the parts that are there."""
    weights = numeric.QUALITY_WEIGHTS
    rng = random.Random(6)
    rows = [tuple(None if rng.random() < 0.4 else round(rng.random(), 3) for _ in weights) for _ in range(30)] + [(None,) * len(weights)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in weights))
    got = [r["t"] for r in df.select("i", numeric.total_score({c: F.col(c) for c in weights}).alias("t")).orderBy("i").collect()]
    for r, t in zip(rows, got, strict=True):
        there = [(v, w) for v, w in zip(r, weights.values(), strict=True) if v is not None]
        assert abs(t - (100 * sum(v * w for v, w in there) / sum(w for _, w in there) if there else 0.0)) < 0.051


def test_places(spark):
    rng = random.Random(9)
    pairs = [tuple(rng.uniform(-80, 80) for _ in range(4)) for _ in range(20)] + [(0.0, 0.0, 0.0, 90.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    got = [r["km"] for r in df.select("i", numeric.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).orderBy("i").collect()]
    for (a, b, c, d), km in zip(pairs, got, strict=True):
        a, b, c, d = map(math.radians, (a, b, c, d))
        cos = math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)
        assert abs(km - 6371 * math.acos(max(-1, min(1, cos)))) < 6
    row = spark.range(1).select(
        numeric.valid_geo(F.lit(0.0), F.lit(0.0)).alias("null_island"),
        numeric.degrees(F.array(F.lit(42.0), F.lit(15.0), F.lit(18.0)), F.lit("W")).alias("west"),
        numeric.gps_point(F.lit(-3.98765432), F.lit(0.0)).alias("point"),
    ).first()
    assert row["null_island"] is None and abs(row["west"] + 42.255) < 1e-9 and tuple(row["point"]) == (-3.987654, 0.0)


def test_names(spark):
    assert column(spark, ["q/w.HEIC", ".cfg", "q/.w.mov", "e.r.t.Bz2", "plain", ""], "string", text.extension) == [".heic", "", ".mov", ".bz2", "", ""]
    assert column(spark, ["old_tape-side__b"], "string", text.nice_title) == ["old tape - side b"]
    assert column(spark, ["\x00\x00Lumo ", "\x00", None], "string", text.clean_text) == ["Lumo", None, None]
    pair = lambda v: text.make_and_model(F.lit("Lumo"), v)
    assert column(spark, ["Lumo X2", "X2", None], "string", pair) == ["Lumo X2", "Lumo X2", "Lumo"]


def test_json_ids(spark):
    got = column(spark, ["[3,1]", None], "string", lambda v: text.ids_to_json(text.add_id(text.ids_from_json(v), F.lit(2))))
    assert got == ["[1,2,3]", "[2]"]


def test_range_text(spark):
    rows = [
        (datetime(2017, 9, 12, 0, 1), datetime(2017, 9, 12, 23, 59), "12 Sep 2017"), (datetime(2017, 9, 12, 23), datetime(2017, 9, 30, 1), "12 – 30 Sep 2017"),
        (datetime(2017, 2, 28), datetime(2017, 11, 5), "28 Feb – 5 Nov 2017"), (datetime(2008, 11, 5), datetime(2017, 11, 5), "5 Nov 2008 – 5 Nov 2017"),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want string")
    assert all(r["t"] == r["want"] for r in df.select(dates.date_text(F.col("a"), F.col("b")).alias("t"), "want").collect())


def test_scores_that_views_do_not_show(spark):
    """Exposure of levels, usability of a face, sizes and vectors by their formulas."""
    rng = random.Random(2)
    levels = [[rng.randrange(256) for _ in range(64)] for _ in range(5)] + [[0] * 10, [255] * 10]
    for got, x in zip(column(spark, levels, "array<int>", numeric.exposure_from_levels), levels, strict=True):
        y = [v / 255 for v in x]
        dark, bright, mean = sum(v < 0.03 for v in y) / len(y), sum(v > 0.97 for v in y) / len(y), sum(y) / len(y)
        want = 1 - abs(mean - 0.48) * 1.4 - 1.5 * max(0, dark - 0.05) - 1.5 * max(0, bright - 0.05)
        assert abs(got - min(1, max(0, want))) < 1e-9
    faces = [(rng.random(), rng.randrange(10, 150), rng.random()) for _ in range(12)]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "i int, d double, s int, q double")
    got = [r["u"] for r in df.select("i", numeric.face_usability(F.col("d"), F.col("s"), F.col("q")).alias("u")).orderBy("i").collect()]
    for (d, s, q), u in zip(faces, got, strict=True):
        want = 0 if s < 24 else 0.4 * min(1, max(0, (d - 0.5) / 0.4)) + 0.3 * min(1, (s - 24) / 88) + 0.3 * q
        assert abs(u - want) < 6e-4
    a, b = [3.0, 4.0, 0.0], [0.0, 5.0, 12.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(numeric.cosine(F.col("a"), F.col("b")).alias("c"), numeric.normalised(F.col("a")).alias("n")).first()
    assert abs(row["c"] - 20 / 65) < 1e-9 and all(abs(x - y) < 1e-6 for x, y in zip(row["n"], (0.6, 0.8, 0.0), strict=True))
