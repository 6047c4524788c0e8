"""Column expressions: parsing, cleaning, labelling, clipping and unit changes.

All are plain Spark expressions, so they stay in generated code and are pushed
to the scan where they filter.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.sources.schema import Protocol


def parse_timestamp(text: Column) -> Column:
    """Local time without zone; " 24:00" is 00:00 of the next day, what cannot be read is NULL."""
    trimmed = F.trim(text)
    late = r"[ T]24:00(:00(\.0+)?)?$"
    day = F.try_to_timestamp(F.regexp_replace(trimmed, late, " 00:00:00")).cast("timestamp_ntz")
    return F.when(trimmed.rlike(late), day + F.expr("INTERVAL 1 DAY")).otherwise(day)


def number(text: Column) -> Column:
    """A number, or NULL where the text is none."""
    return text.try_cast("double")


def in_range(value: Column, low: float | None = None, high: float | None = None, sentinel: float = -99.0) -> Column:
    """NULL for the sentinel, for what is not finite and for what lies outside the bounds."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | (value == sentinel)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return F.when(~bad, value)


def all_zero(*values: Column) -> Column:
    """Whether every value is exactly zero; a NULL is none."""
    out = F.lit(True)
    for value in values:
        out = out & F.coalesce(value == 0, F.lit(False))
    return out


def cyclic(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


FEATURE_SETS = {
    "simple": ("wind",),
    "wind_only": ("wind", "wind_10"),
    "full": ("wind", "wind_10", "temperature", "pressure", "humidity"),
    "full_dir": ("wind", "wind_10", "temperature", "pressure", "humidity", "direction"),
    "full_dir_cyclic": ("wind", "wind_10", "temperature", "pressure", "humidity", "direction_sin", "direction_cos"),
}


def feature_columns(columns: list[str], feature_set: str) -> list[Column]:
    """The columns of a feature set, as far as the table has them."""
    names = FEATURE_SETS.get(feature_set, FEATURE_SETS["simple"])
    derived = {"direction_sin": 0, "direction_cos": 1}
    out = []
    for name in names:
        if name in derived and "direction" in columns:
            out.append(cyclic(F.col("direction"))[derived[name]].alias(name))
        elif name in columns:
            out.append(F.col(name))
    return out


def split_label(ts: Column, protocol: Protocol) -> Column:
    """The split whose half-open interval holds the time, else "outside"."""
    out = F.lit("outside")
    bounds = [F.lit(b).cast("timestamp_ntz") for b in protocol.boundaries]
    when = ts.cast("timestamp_ntz")
    for k in reversed(range(len(protocol.names))):
        out = F.when((when >= bounds[k]) & (when < bounds[k + 1]), protocol.names[k]).otherwise(out)
    return out


def domain_mask(split: Column, extreme: Column, name: str, domain: str | None = None) -> Column:
    """Rows of a split, and of its source (normal) or target (extreme) domain."""
    here = split == name
    if domain is None:
        return here
    return here & (extreme if domain == "target" else ~extreme)


def first_reason(non_contiguous: Column, invalid_power: Column, missing_weather: Column, outside: Column) -> Column:
    """The first reason that holds, in this order, else "accepted"."""
    reasons = (("non_contiguous", non_contiguous), ("invalid_power", invalid_power), ("missing_domain_weather", missing_weather), ("outside_period", outside))
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in reasons), F.lit("accepted"))


def event_category(cold: Column, hot: Column) -> Column:
    return F.when(cold, "cold").when(hot, "hot").otherwise("wind")


def season(ts: Column) -> Column:
    month = F.month(ts)
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def week_block(ts: Column) -> Column:
    """Number of the 7-day block from Monday 1970-01-05."""
    return F.floor(F.date_diff(F.to_date(ts), F.lit("1970-01-05").cast("date")) / 7).cast("long")


def block_from(ts: Column, origin: Column) -> Column:
    """Number of the 7-day block from the given first day."""
    return F.floor(F.date_diff(F.to_date(ts), F.to_date(origin)) / 7).cast("long")


def clip_bounds(lower: Column, upper: Column, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """Clips the lower bound from below, the upper from above, then keeps their order; NULL stays NULL."""
    a = lower if low is None else F.when(lower.isNotNull(), F.greatest(lower, F.lit(low)))
    b = upper if high is None else F.when(upper.isNotNull(), F.least(upper, F.lit(high)))
    return a, F.when(a.isNotNull() & b.isNotNull(), F.greatest(b, a))


def ordered(lower: Column, upper: Column) -> tuple[Column, Column]:
    both = lower.isNotNull() & upper.isNotNull()
    return F.when(both, F.least(lower, upper)), F.when(both, F.greatest(lower, upper))


def rearranged(*quantiles: Column) -> Column:
    """The row's quantiles in rising order."""
    return F.array_sort(F.array(*quantiles))


def scale_width(lower: Column, upper: Column, factor: float) -> tuple[Column, Column]:
    centre, half = (lower + upper) / 2, (upper - lower) / 2 * factor
    return centre - half, centre + half


def expand(lower: Column, upper: Column, by: Column, scaled: bool = False) -> tuple[Column, Column]:
    """Widens by an amount, or by a multiple of the width (of 1e-6 at least)."""
    step = by * F.greatest(upper - lower, F.lit(1e-6)) if scaled else by
    return lower - step, upper + step


def standardise(value: Column, mean: Column, scale: Column) -> Column:
    """A missing value counts as the mean, a zero scale as one."""
    return (F.coalesce(value, mean) - mean) / F.when(scale == 0, 1.0).otherwise(scale)


def unstandardise(z: Column, mean: Column, scale: Column, capacity: Column | None = None) -> Column:
    out = z * scale + mean
    return out if capacity is None else out * capacity


def parse_snr(text: str) -> list[float]:
    """A list of decibels; inf is no noise."""
    return [float(p) for p in text.split(",") if p.strip()]


def noise_sigma(power: Column, decibel: float) -> Column:
    return F.lit(0.0) if math.isinf(decibel) else F.sqrt(power / 10 ** (decibel / 10))


def add_noise(value: Column, sigma: Column, key: Column, seed: int) -> Column:
    """Gaussian noise that depends on the row's key and the seed only (Box-Muller over two hashes)."""
    span = F.lit(float(1 << 53))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 1) / (span + 1)
    v = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit("v")), 11).cast("double") / span
    return value + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def stable_seed(base: int, *parts: object) -> int:
    """First 8 bytes, little-endian, of the SHA-256 of the parts joined by bars."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (base, *parts))).encode()).digest()[:8], "little")


def seed_values(text: Column) -> Column:
    """A list of numbers from its text; NULL unless all are finite and not negative."""
    values = F.from_json(text, "array<double>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    return F.when((F.size(values) > 0) & fine, values)


def site_of(task: Column) -> Column:
    return F.substring_index(task, "site", -1).try_cast("int")


def loss_weights(n_source: int, n_target: int, total: float, scheme: str, task: str = "point") -> tuple[float, float]:
    """Weight of a source row and of a target row; all rows together weigh ``total``."""
    if n_source < 0 or n_target <= 0:
        raise ValueError("there must be target rows")
    if n_source == 0:
        return 0.0, total / n_target
    # weight of a target row as a multiple of that of a source row
    multiples = {"domain_balanced": n_source / n_target, "sample_equal": 1.0, "historical_ratio": 3000.0 if task == "point" else 8000.0, "target_10x": 10 * n_source / n_target}
    if scheme not in multiples:
        raise ValueError(f"unknown scheme {scheme}")
    source = total / (n_source + multiples[scheme] * n_target)
    return source, source * multiples[scheme]


def direction(value: Column) -> Column:
    return F.when(value < 0, "lower").when(value > 0, "higher").when(value == 0, "equal")


def nearly_equal(a: Column, b: Column, tolerance: float = 2e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def conformal_score(y: Column, lower: Column, upper: Column, scaled: bool = False) -> Column:
    score = F.greatest(lower - y, y - upper, F.lit(0.0))
    return score / F.greatest(upper - lower, F.lit(1e-6)) if scaled else score


def hours(rows: Column, step_minutes: int = 15) -> Column:
    return rows * (step_minutes / 60)


def pinball(y: Column, q: Column, tau: float) -> Column:
    r = y - q
    return F.greatest(tau * r, (tau - 1) * r)


def interval_score(y: Column, lower: Column, upper: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return (upper - lower) + 2 / alpha * (F.greatest(lower - y, zero) + F.greatest(y - upper, zero))
