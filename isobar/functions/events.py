"""Scalar rules: intensity buckets, severity bands and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wind (knots) at which each intensity category starts.
CATEGORY_STARTS = [(113.0, 5), (96.0, 4), (83.0, 3), (64.0, 2), (34.0, 1)]

# Category names.
CATEGORY_NAMES = {
    0: "Tropical Depression",
    1: "Category 1",
    2: "Category 2",
    3: "Category 3",
    4: "Category 4",
    5: "Category 5",
}

# Probability at which each severity band starts.
SEVERITY_STARTS = [(0.75, "severe"), (0.5, "warning"), (0.3, "watch")]


def _bucket(col: Column, starts: list[tuple[float, object]], default: object) -> Column:
    """The name of the first start, from the highest down, that the value reaches."""
    return F.coalesce(*[F.when(col >= start, F.lit(name)) for start, name in starts],
                      F.lit(default))


def cyclone_category(wind: Column) -> Column:
    """Intensity 0 to 5 from wind in knots; missing wind is 0."""
    return _bucket(wind, CATEGORY_STARTS, 0)


def category_text(category: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair])
    unknown = F.concat(F.lit("Unknown (category "), category.cast("string"), F.lit(")"))
    return F.coalesce(F.try_element_at(names, category.cast("int")), unknown)


def severity_band(probability: Column) -> Column:
    return F.when(probability.isNotNull(), _bucket(probability, SEVERITY_STARTS, "none"))


def positive(probability: Column) -> Column:
    return probability >= 0.5


def confidence(probability: Column) -> Column:
    return F.round(F.greatest(probability, 1 - probability), 3)


def argmax_class(probabilities: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def probability_map(probabilities: Column) -> Column:
    """``{"0": p0, "1": p1, ...}``."""
    names = F.transform(F.sequence(F.lit(0), F.size(probabilities) - 1),
                        lambda i: i.cast("string"))
    return F.map_from_arrays(names, probabilities)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")
