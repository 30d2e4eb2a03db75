"""Scalar expressions: Column in, Column out, all inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, thresholds and labels the results are defined by.
ACTION_WEIGHTS = {"purchase": 5.0, "add_to_cart": 3.0, "view": 1.0}
PRICE_CUTS = (5_000_000.0, 15_000_000.0, 30_000_000.0)
LONG_COMMENT, MEDIUM_COMMENT = 100, 50


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def price_numeric(price: Column | str) -> Column:
    """``15.990.000đ`` -> 15990000.0; null when there is no digit."""
    return F.regexp_replace(_c(price), "[^0-9]", "").try_cast("double")


def sold_numeric(sold: Column | str) -> Column:
    """Compact counts: ``1k2`` -> 1200, ``12k`` -> 12000, ``1,5k`` -> 1500, ``950`` -> 950; words may follow."""
    text = F.lower(F.trim(_c(sold)))
    split_k = r"([0-9]+)k([0-9]+)"
    decimal_k = r"([0-9]+)[.,]([0-9]+)k\b"
    whole_k = r"([0-9]+)k\b"

    def thousands(pattern: str) -> Column:
        number = F.concat(F.regexp_extract(text, pattern, 1), F.lit("."), F.regexp_extract(text, pattern, 2))
        return F.round(number.try_cast("double") * 1000, 3)

    return (
        F.when(text.rlike(split_k), thousands(split_k))
        .when(text.rlike(decimal_k), thousands(decimal_k))
        .when(text.rlike(whole_k), F.regexp_extract(text, whole_k, 1).try_cast("double") * 1000)
        .otherwise(F.regexp_replace(text, "[^0-9]", "").try_cast("double"))
    )


def popularity_score(rating: Column | str, sold: Column | str) -> Column:
    return _c(rating) * _c(sold) / 1000


def sentiment_score(rating: Column | str) -> Column:
    """4 and 5 stars count 1, 3 stars 0, anything else (null included) -1."""
    rating = _c(rating)
    return F.when(rating >= 4, 1.0).when(rating == 3, 0.0).otherwise(-1.0)


def sentiment_label(score: Column | str) -> Column:
    score = _c(score)
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def comment_length(comment: Column | str) -> Column:
    return F.length(_c(comment))


def review_weight(length: Column | str) -> Column:
    length = _c(length)
    return F.when(length > LONG_COMMENT, 2.0).when(length > MEDIUM_COMMENT, 1.5).otherwise(1.0)


def action_weight(action: Column | str, weights: dict[str, float] | None = None) -> Column:
    action = _c(action)
    pairs = [(action == name, F.lit(weight)) for name, weight in (weights or ACTION_WEIGHTS).items()]
    first, rest = pairs[0], pairs[1:]
    return reduce(lambda acc, p: acc.when(*p), rest, F.when(*first)).otherwise(0.0)


def product_id_from_url(url: Column | str) -> Column:
    """The id after the last ``-i.`` or, failing that, after ``/product/``; query string dropped."""
    path = F.substring_index(_c(url), "?", 1)
    tail = F.regexp_extract(path, r"-i\.([^/]*)$", 1)
    plain = F.regexp_extract(path, r"/product/([^/]+)$", 1)
    return F.coalesce(F.nullif(tail, F.lit("")), F.nullif(plain, F.lit("")))


def product_features(name: Column, brand: Column, category: Column, description: Column) -> Column:
    """Text that describes a product; falls back to the name when all parts are blank."""
    parts = [F.coalesce(_c(part), F.lit("")) for part in (name, brand, category, description)]
    joined = F.concat_ws(" ", *parts)
    return F.when(F.trim(joined) == "", _c(name)).otherwise(joined)


def price_band(price: Column | str, cuts: tuple[float, ...] = PRICE_CUTS) -> Column:
    """0 below the first cut, 1 from the first up to the second, and so on."""
    price = _c(price)
    band = F.when(price < cuts[0], 0)
    for position, cut in enumerate(cuts[1:], start=1):
        band = band.when(price < cut, position)
    return band.when(price >= cuts[-1], len(cuts))


def star_bucket(rating: Column | str) -> Column:
    rounded = F.floor(_c(rating) + 0.5).cast("int")
    return F.when(rounded.between(1, 5), rounded)


def fill_unknown(column: Column | str, default: str) -> Column:
    return F.coalesce(_c(column), F.lit(default))


def parse_flexible_date(text: Column | str) -> Column:
    """``yyyy-MM-dd``, ``yyyy/MM/dd`` or epoch milliseconds; null for anything else."""
    text = _c(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy/MM/dd")),
        F.timestamp_millis(text.try_cast("bigint")),
    ).cast("date")


def best_algorithm(cf="cf", mf="mf", hybrid="hybrid", labels=("cf", "mf", "hybrid")) -> Column:
    """Label of the highest of three scores; ties go to the third, then to the first."""
    cf, mf, hybrid = _c(cf), _c(mf), _c(hybrid)
    top = F.greatest(cf, mf, hybrid)
    return F.when(hybrid == top, labels[2]).when(cf == top, labels[0]).otherwise(labels[1])


def nonnegative_clamp(value: Column | str) -> Column:
    return F.greatest(_c(value), F.lit(0.0))


def recommendation_score(score: Column | str, popularity: Column | str) -> Column:
    return _c(score) * _c(popularity)


def ranking_key(score: Column | str) -> Column:
    """Scores are ranked at nine decimals so that summation order never decides a tie."""
    return F.round(_c(score), 9)
