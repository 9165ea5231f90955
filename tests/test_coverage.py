"""Stored intervals against sets of days."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from isobar.operators import coverage

START, END = dt.date(2019, 12, 1), dt.date(2021, 2, 1)


def runs_of(days):
    out = []
    for d in sorted(days):
        if out and d == out[-1][1] + dt.timedelta(days=1):
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def test_intervals_and_holes_equal_sets_of_days(spark):
    rng = random.Random(1)
    every = [START + dt.timedelta(days=k) for k in range(-40, (END - START).days + 40)]
    held = {c: {d for d in every if rng.random() < p} for c, p in (("a", 0.9), ("b", 0.3), ("c", 1))}
    held["c"] -= {dt.date(2020, 1, 1)}
    rows = [(c, d) for c, days in held.items() for d in days for _ in range(rng.randrange(1, 3))]
    rng.shuffle(rows)
    stored = None
    for at in range(0, len(rows), 500):  # batch by batch, in any order
        batch = spark.createDataFrame(rows[at:at + 500] + [(None, START), ("a", None)],
                                      "city string, time date")
        stored = coverage.intervals(batch) if stored is None else coverage.extended(stored, batch)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
    got = sorted(map(tuple, stored.collect()))
    assert got == sorted((c, *r) for c, days in held.items() for r in runs_of(days))
    cities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "city string")
    found = coverage.holes(cities, stored, F.lit(START), F.lit(END), skip=["e"]).collect()
    want = []
    for c in "abcd":
        missing = {d for d in every if START <= d <= END} - held.get(c, set())
        want += [(c, a, z, (z - a).days + 1) for a, z in runs_of(missing)]
    assert sorted(map(tuple, found)) == sorted(want)
    none = coverage.holes(cities.where("city = 'c'"), stored, F.lit(dt.date(2020, 5, 1)),
                          F.lit(dt.date(2020, 6, 1)))
    assert none.collect() == []
