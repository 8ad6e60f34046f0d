"""Kernel parameters and the small tables that follow from them, made on the driver.

The estimated kernels use the orthogonal projector onto functions of at most k coordinates
of the Hamming scheme H(l, 4), written with Krawtchouk polynomials.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

#: Number, name and alias of each kernel.
KERNELS = {0: ("gkm_cnt", "direct"), 1: ("gkm_estfull", "estimated_full"), 2: ("gkm_esttrunc", "estimated"), 3: ("gkmrbf", "rbf"), 4: ("wgkm", "weighted"), 5: ("wgkmrbf", "weighted_rbf"), 6: ("gkm_cnt_rbf", "direct_rbf")}
#: The first value of the filter below this ends the truncated filter.
CUT = Fraction(1, 10**50)


def resolve_kernel_type(kernel: str | int) -> int:
    """The kernel's number, from its number, name or alias."""
    for number, names in KERNELS.items():
        if kernel == number or str(kernel) == str(number) or str(kernel).lower() in names:
            return number
    raise ValueError(f"unknown kernel type {kernel!r}; known: {', '.join(f'{n} {a} ({b})' for n, (a, b) in KERNELS.items())}")


def krawtchouk(l: int, j: int, m: int) -> int:
    return sum((-1) ** i * 3 ** (j - i) * math.comb(m, i) * math.comb(l - m, j - i) for i in range(j + 1))


@lru_cache
def estimated(l: int, k: int, truncated: bool) -> tuple[float, ...]:
    """h(m) for m = 0..l: the filter, or the convolution of the truncated filter with itself."""
    g = [Fraction(sum(krawtchouk(l, j, m) for j in range(k + 1)), 4**l) for m in range(l + 1)]
    if truncated:
        end = next((m for m, v in enumerate(g) if v < CUT), l + 1)
        g = [v if m < end else Fraction(0) for m, v in enumerate(g)]
        power = [sum(g[i] * krawtchouk(l, i, j) for i in range(l + 1)) ** 2 for j in range(l + 1)]
        g = [sum(power[j] * krawtchouk(l, j, m) for j in range(l + 1)) / 4**l for m in range(l + 1)]
    return tuple(map(float, g))


@dataclass(frozen=True)
class Kernel:
    """d None: pairs count at any number of mismatches. M and H: weights of -t 4 and 5."""

    kind: int = 2
    l: int = 11
    k: int = 7
    d: int | None = 3
    gamma: float = 1.0
    M: int = 50
    H: float = 50.0
    include_rc: bool = True
    normalize: bool = True

    def __post_init__(self):
        object.__setattr__(self, "kind", resolve_kernel_type(self.kind))
        if not 1 <= self.k <= self.l or self.l > 15:
            raise ValueError(f"need 1 <= k <= l <= 15, got l={self.l}, k={self.k}")
        if self.weighted and not (1 <= self.M <= 255 and self.H > 0):
            raise ValueError("need 1 <= M <= 255 and H > 0")

    @property
    def rbf(self) -> bool:
        return self.kind in (3, 5, 6)

    @property
    def weighted(self) -> bool:
        return self.kind in (4, 5)

    @property
    def h(self) -> tuple[float, ...]:
        """Weight of a pair of l-mers by its number of mismatches, 0 to l."""
        if self.kind in (0, 6):
            table = tuple(float(math.comb(self.l - m, self.k)) if self.l - m >= self.k else 0.0 for m in range(self.l + 1))
        else:
            table = estimated(self.l, self.k, self.kind != 1)
        return tuple(v if self.d is None or m <= self.d else 0.0 for m, v in enumerate(table))

    @property
    def reach(self) -> int:
        """Most mismatches with a weight."""
        return max((m for m, v in enumerate(self.h) if v), default=0)

    def window_weight(self, i: int, n: int) -> int:
        """Weight of window i of n, for the centre-weighted kernels."""
        return min(self.M, math.floor(self.M * math.exp(-math.log(2) * abs(n // 2 - i) / self.H) + 1)) if self.weighted else 1


@lru_cache
def mask_levels(h: tuple[float, ...]) -> dict[int, float]:
    """Size of position subset -> coefficient, such that h(m) is the sum over sizes j of
    coefficient * C(l - m, j): the number of subsets of j positions on which a pair with m
    mismatches agrees. Solved from the most mismatches down."""
    l = len(h) - 1
    out: dict[int, float] = {}
    for m in range(l, -1, -1):
        rest = h[m] - sum(a * math.comb(l - m, j) for j, a in out.items())
        if abs(rest) > 1e-12 * max(map(abs, h)):
            out[l - m] = rest
    return out


def position_bits(l: int, positions) -> int:
    """Mask of packed l-mers (first base most significant) over some positions."""
    return sum(3 << 2 * (l - 1 - i) for i in positions)


@lru_cache
def masks(h: tuple[float, ...]) -> list[tuple[int, float]]:
    """(mask, coefficient) of every position subset that the kernel needs."""
    l = len(h) - 1
    return [(position_bits(l, c), a) for j, a in sorted(mask_levels(h).items()) for c in combinations(range(l), j)]


def importance_weights(h: tuple[float, ...], d: int | None) -> tuple[list[float], list[float]]:
    """Per number of mismatches: share of a pair's weight of each matching position, and what
    a mismatching position would be worth if it matched."""
    l = len(h) - 1
    match = [h[m] / (l - m) if m < l else 0.0 for m in range(l + 1)]
    most = d if d is not None else max((m for m in range(l + 1) if h[m]), default=0) + 1
    other = [h[m - 1] / (l - m + 1) if 1 <= m <= most else 0.0 for m in range(l + 1)]
    return match, other


def perturbation_weights(h: tuple[float, ...]) -> tuple[list[float], list[float]]:
    """Change of a pair's weight when a match is broken, and when a mismatch is mended."""
    l = len(h) - 1
    broken = [(h[m + 1] if m < l else 0.0) - h[m] for m in range(l + 1)]
    mended = [h[m - 1] - h[m] if m else 0.0 for m in range(l + 1)]
    return broken, mended


def neighbour_bits(l: int, reach: int) -> list[tuple[int, int]]:
    """(xor mask, mismatches) of every l-mer within reach."""
    out = [(0, 0)]
    level = [(0, -1)]
    for m in range(1, reach + 1):
        level = [(x | (c << 2 * i), i) for x, last in level for i in range(last + 1, l) for c in (1, 2, 3)]
        out += [(x, m) for x, _ in level]
    return out
