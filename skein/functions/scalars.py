"""Scalar functions on columns: text, dates, scores, arrays, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_year(title: Column) -> tuple[Column, Column]:
    """``Title (YYYY)`` as name and year; without a year the whole title and 0."""
    pattern = r"^(.+?)\s*\((\d{4})\)\s*$"
    has = title.rlike(pattern)
    return F.when(has, F.regexp_extract(title, pattern, 1)).otherwise(title), F.when(has, F.regexp_extract(title, pattern, 2).cast("long")).otherwise(F.lit(0))


def pad_id(prefix: str, width: int, key: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", key)


def split_genres(text: Column, missing: str = "(no genres listed)") -> Column:
    return F.when(text == missing, F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def norm_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), "[^a-z0-9_]", "_")


def joined(sep: str, *parts: Column) -> Column:
    """Non-empty parts between separators."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def requirements(text: Column, stop: list[str]) -> Column:
    """Distinct words over 3 letters of a question, stop words aside, in order."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*stop)))


def title_score(title: Column, wanted: str) -> Column:
    return F.when(F.contains(F.lower(title), F.lit(wanted.lower())), F.lit(float(len(wanted))) / F.length(title)).otherwise(0.0)


def title_match(title: Column, wanted: str) -> Column:
    low, w = F.lower(title), wanted.lower()
    return F.when(low == w, 1.0).when(F.contains(low, F.lit(w)), 0.95).when(F.contains(low, F.lit(w[:3])), 0.85).otherwise(0.8)


def explain(score: Column) -> Column:
    return F.when(score >= 0.8, "very similar").when(score >= 0.5, "similar").when(score >= 0.2, "related").otherwise("distant")


def render(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def iri_label(iri: Column) -> Column:
    return F.element_at(F.split(iri, "[#/]"), -1)


def md5_int(text: Column) -> Column:
    """The first 32 bits of an MD5 as an integer."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").when(h >= 22, "night").otherwise("late_night")


def decay(age: Column, half_life: float) -> Column:
    """Halves with each half-life; 1 where the half-life is about 0."""
    return F.lit(1.0) if abs(half_life) < 1e-9 else F.exp(-F.lit(0.6931471805599453) * age / half_life)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reward(mode: str, success: Column, value: Column, latency: Column) -> Column:
    """Reward by mode, within 0..1."""
    ok = success.cast("double")
    shapes = {"standard": value, "sparse": ok, "dense": 0.5 * value + 0.5 * ok, "shaped": value * (1 - F.least(latency / 1000, F.lit(1.0)) * 0.1) + 0.1 * ok}
    return clamp(shapes[mode], 0.0, 1.0)


def doubly_robust(mu1: Column, mu0: Column, y: Column, propensity: Column) -> Column:
    """Model difference corrected by the weighted residual of the treated."""
    return (mu1 - mu0) + (y - mu1) / propensity


def ucb1(q: Column, n: Column, total: Column) -> Column:
    return q + F.sqrt(2 * F.log(total) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements; 0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def map_jaccard(a: Column, b: Column) -> Column:
    """Keys with equal values over all keys."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    same = F.filter(keys, lambda k: F.try_element_at(a, k) == F.try_element_at(b, k))
    return F.when(F.size(keys) == 0, 0.0).otherwise(F.size(same) / F.size(keys))


def bit_jaccard(a: Column, b: Column) -> Column:
    return F.when(a.bitwiseOR(b) == 0, 0.0).otherwise(F.bit_count(a.bitwiseAND(b)) / F.bit_count(a.bitwiseOR(b)))


def mood_distance(a: list[Column], b: list[Column]) -> Column:
    """Similarity of two valence, arousal, dominance points."""
    return 1 - F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)) / 3)


def entropy(p: Column) -> Column:
    """Bits of a distribution held as an array."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def kl(p: Column, q: Column) -> Column:
    terms = F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def js(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, m) + kl(q, m)) / 2


def hex_channel(color: Column, i: int) -> Column:
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("long")


def aesthetic(color: Column) -> Column:
    """Noir, vibrant or pastel by luminance and saturation of #rrggbb."""
    r, g, b = (hex_channel(color, i) / 255 for i in range(3))
    light = 0.299 * r + 0.587 * g + 0.114 * b
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    saturation = F.when(high == 0, 0.0).otherwise((high - low) / high)
    return F.when(light < 0.25, "noir").when(saturation > 0.6, "vibrant").when(light > 0.7, "pastel").otherwise("neutral")
