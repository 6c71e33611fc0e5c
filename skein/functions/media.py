"""Classifiers of media features by fixed bands, and scores of media against a context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(xs: Column) -> Column:
    """Mean of an array of doubles; null when empty."""
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def spread(xs: Column) -> Column:
    """Population standard deviation of an array of doubles.

    From sums of the gaps to the first value: of values with few binary places these are
    exact, so that a deviation on the edge of a band is not moved over it by rounding.
    """
    gaps, n = F.transform(xs, lambda x: x - F.element_at(xs, 1)), F.size(xs).cast("double")
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return F.sqrt(F.abs(F.try_divide(n * squares - total * total, n * n)))  # rounding may take a deviation of nearly 0 below it


# Band edges, labels and confidences of the classifiers below.


def motion_genres(magnitude: Column, frequency: Column) -> Column:
    """Genres with confidences that arrays of motion magnitudes and frequencies suggest."""
    m, f = mean(magnitude), mean(frequency)
    found = [((m > 0.7) & (f > 0.6), "Action", 0.85), ((m < 0.3) & (f < 0.3), "Drama", 0.80), ((m > 0.4) & (m < 0.7) & (spread(frequency) > 0.2), "Thriller", 0.75)]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(g).alias("label"), F.lit(p).alias("confidence"))) for c, g, p in found]))


def lighting_mood(key_ratio: Column, shadow: Column, kelvin: Column) -> Column:
    """Lighting label; null between the bands."""
    return F.when((key_ratio > 0.8) & (shadow < 0.3), "HighKey").when((key_ratio < 0.4) & (shadow > 0.7), "LowKey").when(kelvin > 3500, "WarmLighting").when(kelvin < 3000, "CoolLighting")


def complexity_level(x: Column) -> Column:
    return F.when(x < 0.3, "Children").when(x < 0.5, "Family").when(x < 0.7, "General").when(x < 0.85, "Mature").otherwise("Academic")


def complexity_confidence(x: Column) -> Column:
    """0.7 and more, rising with the distance to the nearest band edge."""
    edge = F.least(*[F.abs(x - e) for e in (0.3, 0.5, 0.7, 0.85)])
    return 0.7 + F.least(edge * 0.6, F.lit(0.25))


def sound_markers(x: Column) -> Column:
    one = lambda label, score: F.struct(F.lit(label).alias("label"), score.alias("confidence"))
    return (
        F.when(x > 0.8, F.array(one("Cinematic", x), one("Immersive", x * 0.9)))
        .when(x > 0.6, F.array(one("Professional", x)))
        .when(x < 0.3, F.array(one("Minimalist", 1 - x)))
        .otherwise(F.array().cast("array<struct<label:string,confidence:double>>"))
    )


def narrative_arc(start: Column, peak: Column, end: Column, points: Column, deviation: Column) -> Column:
    """Shape of a story from its first, greatest and last tension, the number of its points and their standard deviation."""
    return (
        F.when((peak > start) & (end - start > 0.3), "HeroJourney")
        .when(start - end > 0.3, "Tragedy")
        .when((points > 3) & (deviation > 0.3), "ComplexNarrative")
        .when((F.abs(end - start) < 0.2) & (peak - start < 0.3), "SliceOfLife")
        .otherwise("Standard")
    )


def context_fit(network: Column, device: Column, kind: Column, size_mb: Column, seconds: Column) -> Column:
    """Share of quality left when media of a size and length is delivered over a network to a device; unknown sizes cost nothing."""
    net = F.when((network == "poor") & (size_mb > 100), 0.3).when((network == "fair") & (size_mb > 500), 0.6).when((network == "good") & (size_mb > 2000), 0.8).otherwise(1.0)
    dev = F.when((device == "mobile") & (kind == "video") & (F.coalesce(seconds, F.lit(0)) > 3600), 0.7).when((device == "tv") & (kind == "text"), 0.4).otherwise(1.0)
    return net * dev


def cultural_match(languages: Column, themes: Column, genres: Column, language: Column, region: Column, wanted: Column, taste: Column, taboos: Column) -> Column:
    """Weighted match of language .3, region .25, themes .25 and taste .15, less taboos; parts without data drop out of the weights."""
    base = lambda x: F.element_at(F.split(x, "-"), 1)
    lang = F.when(F.array_contains(languages, language), 1.0).when(base(F.try_element_at(languages, F.lit(1))) == base(language), 0.7).otherwise(0.0)
    area = F.exists(languages, lambda x: F.contains(x, region)).cast("double")
    told = (F.size(themes) > 0) & (F.size(wanted) > 0)
    theme = F.when(told, F.size(F.filter(themes, lambda t: F.array_contains(wanted, t))) / F.greatest(F.size(themes), F.size(wanted))).otherwise(0.0)
    liked = F.array_compact(F.transform(genres, lambda g: F.try_element_at(taste, g)))
    known = F.size(liked) > 0
    hits = F.size(F.filter(themes, lambda t: F.array_contains(taboos, t)))
    total = lang * 0.3 + area * 0.25 + theme * 0.25 + F.coalesce(mean(liked), F.lit(0.0)) * 0.15 + F.greatest(-hits * 0.5, F.lit(-1.0))
    weight = F.lit(0.6) + F.when(told, 0.25).otherwise(0.0) + F.when(known, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight))


def preference(labels: Column, taste: Column) -> Column:
    """Mean taste over all labels, labels without a known taste as 0; 0 without labels."""
    return F.coalesce(mean(F.transform(labels, lambda g: F.coalesce(F.try_element_at(taste, g), F.lit(0.0)))), F.lit(0.0))


def rolling_hash(text: Column) -> Column:
    """``h * 31 + byte`` over the UTF-8 bytes, modulo 2 to the 32nd."""
    octets = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(0).cast("long"), lambda h, b: F.pmod(h * 31 + b, F.lit(4294967296)))


def numbered_steps(text: Column, most: int = 5) -> Column:
    """The first distinct ``1. step`` lines of a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+\. ([a-zA-Z ]+)"), F.lit(1))), 1, most)
