"""Column expressions: subsets, noise, sampling keys, ratios and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical(itemset: Column | str) -> Column:
    """Items in ascending order, so that equal sets have equal keys."""
    return F.array_sort(_c(itemset))


def subsets(itemset: Column | str, proper: bool = True, least: int = 1) -> Column:
    """All non-empty subsets in the order of their bit masks; ``proper`` leaves out the set itself, ``least`` is the smallest size."""
    a = _c(itemset)
    last = F.call_function("shiftleft", F.lit(1), F.size(a)) - (2 if proper else 1)
    masks = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    found = F.transform(masks, lambda m: F.filter(a, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    return F.filter(found, lambda s: F.size(s) >= least) if least > 1 else found


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the parts only, whatever the partitioning. Not secret: for released results take a secret seed."""
    text = F.concat_ws("|", *(F.lit(p).cast("string") if isinstance(p, int) else _c(p).cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4503599627370496.0)


def laplace_noise(u: Column | str, scale: Column | float) -> Column:
    """Laplace noise of that scale from a uniform number."""
    r, b = F.lit(0.5) - _c(u), scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(r < 0, b * F.log(1 + 2 * r)).otherwise(-b * F.log(1 - 2 * r))


def laplace_mechanism(x: Column | str, u: Column | str, eps: Column | float, sensitivity: float = 1.0) -> Column:
    """A count released with privacy ``eps``, never below 0."""
    scale = F.lit(sensitivity) / (eps if isinstance(eps, Column) else F.lit(float(eps)))
    return F.greatest(_c(x) + laplace_noise(u, scale), F.lit(0.0))


def div_or_zero(a: Column | str, b: Column | str) -> Column:
    """a / b, where 0/0 is 0 and a/0 is infinite."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    over = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    return F.when(b == 0, over).otherwise(a / F.when(b != 0, b))


def sampling_key(u: Column | str, weight: Column | str) -> Column:
    """The smaller, the likelier with the weight to be drawn."""
    return -F.log(_c(u)) / _c(weight)


def sampling_key_log(u: Column | str, log_weight: Column | str) -> Column:
    """The same order from the logarithm of the weight, which may be large."""
    return F.log(F.log(1 / _c(u))) - _c(log_weight)


def quality_delta(sup_ab: Column | str, sup_prefix: Column | str) -> Column:
    return _c(sup_ab) - _c(sup_prefix)


def quality_d(sup_ab: Column | str, sup_x: Column | str, c0: Column | float, asymmetric: bool = False) -> Column:
    """-|sup_ab / c0 - sup_x|; asymmetric: only a lack counts."""
    gap = _c(sup_ab) / (c0 if isinstance(c0, Column) else F.lit(float(c0))) - _c(sup_x)
    return F.least(gap, F.lit(0.0)) if asymmetric else -F.abs(gap)


def rule_quality(sup_a: Column | str, sup_ab: Column | str, method: str, m: float, theta: float, a: float = 1e6, b: float = 1e3) -> Column:
    """The score of a rule by its two supports: mt, tt, aab, amab, aabtab, exp or xy."""
    x, y = _c(sup_a).cast("double"), _c(sup_ab).cast("double")
    if method in ("mt", "tt"):
        return (F.lit(a) - F.sqrt(F.pow(x - (m if method == "mt" else theta), 2) + F.pow(y - theta, 2))) / F.sqrt(F.lit(2.0))
    if method == "aab":
        return x * y / (2 * m + 1)
    if method == "amab":
        return x * (m - y) / (2 * m - 1)
    if method == "aabtab":
        return x * y * (theta - y) / (2 * m * theta + theta - 1)
    if method == "exp":
        return x * F.exp(-F.abs(theta - y) / b) / (m * (F.exp(F.lit(1.0)) - 1) + F.exp(F.lit(1.0)))
    if method == "xy":

        def triangle(z: Column, low: float, high: float, top: float) -> Column:
            return top * F.greatest(F.lit(0.0), 1 - F.abs(z - top) / (high - low))

        return 0.5 * (1 / theta - 1 / m) * triangle(x, theta, m, m) * triangle(y, theta, m, theta)
    raise ValueError(f"unknown method {method}")


def dataset_name(path: Column | str) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(_c(path), r"([^/.]+)[^/]*$", 1)


def name_part(path: Column | str, from_end: int) -> Column:
    """Part of the file name between underscores, counted from the end; as shelves (3) and bins (1) are given."""
    return F.element_at(F.split(F.element_at(F.split(_c(path), "/"), -1), "_"), -from_end)


def items_text(itemset: Column | str, sep: str = " ") -> Column:
    return F.array_join(F.transform(_c(itemset), lambda x: x.cast("string")), sep)
