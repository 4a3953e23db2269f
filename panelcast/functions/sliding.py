"""Order statistics of windows that slide: each value enters and leaves once."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable


class SortedWindow:
    """The values in a window, in order."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def add(self, values: Iterable[float]) -> None:
        for v in values:
            insort(self.values, v)

    def remove(self, values: Iterable[float]) -> None:
        for v in values:
            del self.values[bisect_left(self.values, v)]

    def quantile(self, q: float) -> float | None:
        """Linear interpolation; None for an empty window."""
        if not self.values:
            return None
        at = q * (len(self.values) - 1)
        low, high = self.values[math.floor(at)], self.values[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))


def trailing_quantiles(slots: list[int], values: list[float], width: int, q: float) -> list[float | None]:
    """Quantile of the last ``width`` slots at each of ``slots`` (in order, some may be absent)."""
    window, first, out = SortedWindow(), 0, []
    for slot, value in zip(slots, values):
        window.add([value])
        while slots[first] <= slot - width:
            window.remove([values[first]])
            first += 1
        out.append(window.quantile(q))
    return out


def circular_quantiles(by_place: list[list[float]], half: int, q: float) -> list[float | None]:
    """Quantile of the values within ``half`` places around each place of a circle."""
    n = len(by_place)
    if 2 * half + 1 >= n:
        whole = SortedWindow()
        whole.add(v for values in by_place for v in values)
        return [whole.quantile(q)] * n
    window, out = SortedWindow(), []
    for k in range(-half, half):
        window.add(by_place[k % n])
    for k in range(n):
        window.add(by_place[(k + half) % n])
        out.append(window.quantile(q))
        window.remove(by_place[(k - half) % n])
    return out
