"""Small tables that depend on parameters only: the privacy budget and the number of possible rules."""

from __future__ import annotations

from math import comb


def budget(eps: float, ratio: float, lmax: int, bf: int, first_item: str = "noisy") -> dict:
    """How ``eps`` is spent: on the item counts and, per level, on each prefix. A draw costs 1/bf of its prefix's share.

    With a "noisy" first item, level 0 draws by the counts that are already released and costs nothing.
    """
    if not (eps > 0 and 0 < ratio < 1 and lmax >= 2 and bf >= 1):
        raise ValueError("eps and ratio must be over 0, ratio below 1, lmax at least 2, bf at least 1")
    free = 1 if first_item == "noisy" else 0
    items = eps * ratio
    levels = {i: (eps - items) / (lmax - free) / bf**i for i in range(free, lmax)}
    return {"items": items, "levels": levels}


def rule_space(n_items: int, lmax: int) -> int:
    """Rules that itemsets of 2 to ``lmax`` items can have."""
    return sum(comb(n_items, k) * (2**k - 2) for k in range(2, lmax + 1))
