import datetime as dt

from pyspark.sql import functions as F

from lexispark.operators import series as sr


def test_gaps_and_rolls(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("s", d(2020, 1, 1), 1.0), ("s", d(2020, 1, 4), 4.0), ("s", d(2020, 1, 5), 5.0), ("s", d(2020, 1, 5), 5.0), ("q", d(2020, 2, 1), 9.0)],
        "series string, date date, y double",
    )
    filled = sr.fill_gaps(df, "series").orderBy("series", "date").collect()
    assert [(r.series, r.date.day, r.y, r.filled) for r in filled] == [
        ("q", 1, 9.0, 0), ("s", 1, 1.0, 0), ("s", 2, 1.0, 1), ("s", 3, 1.0, 1), ("s", 4, 4.0, 0), ("s", 5, 5.0, 0),
    ]
    rolled = sr.roll(sr.fill_gaps(df, "series"), "series", 3, 2, [], impute=True).filter("series = 's'").orderBy("date").collect()
    assert [(r.y_m2, r.y_m1, r.y_p1, r.y_p2) for r in rolled] == [
        (0.0, 0.0, 1.0, 1.0), (0.0, 1.0, 1.0, 4.0), (1.0, 1.0, 4.0, 5.0), (1.0, 1.0, 5.0, None), (1.0, 4.0, None, None),
    ]


def test_rolls_cross_year_ends(spark):
    start = dt.date(2019, 12, 30)
    df = spark.createDataFrame([("s", start + dt.timedelta(i), float(i)) for i in range(4)], "series string, date date, y double")
    rows = sr.roll(df, "series", 2, 1, []).orderBy("date").collect()
    assert [r.y_m1 for r in rows] == [None, 0.0, 1.0, 2.0] and [r.y_p1 for r in rows] == [1.0, 2.0, 3.0, None]


def test_dirty_numbers(spark):
    raw = ["      ", ".", "3.9*", "####", "6.1.", "42.1.", "-", "---", "x", "7", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(sr.clean_number(F.col("r")).alias("y"))
    assert [r.y for r in df.collect()] == [0.0, 0.0, 3.9, 0.0, 6.1, 42.1, 0.0, 0.0, 0.0, 7.0, 0.0]


def test_rank_extremes_with_ties(spark):
    df = spark.createDataFrame([("s", float(v)) for v in [1, 2, 2, 3, 10, 10, 10, 50, 60, 70]], "series string, y double")
    for bucket in (1.0, 1000.0):
        got = sorted((r.y, round(r.pct_rank, 3), r.extreme) for r in sr.extreme_by_rank(df, "series", "y", bucket=bucket).collect())
        assert got[1] == (2.0, 0.25, 0) and got[4] == (10.0, 0.6, 0) and got[-1] == (70.0, 1.0, 1) and got[-2][2] == 1


def test_grid_and_residues(spark):
    row = spark.range(1).select(*sr.grid_cell(F.lit(21.0), F.lit(105.8)), sr.residue_ids(F.lit("AVX"), 5).alias("r")).first()
    assert (row[0], row[1]) == (27, 42) and row.r == [0, 0, 1, 2, 0]
