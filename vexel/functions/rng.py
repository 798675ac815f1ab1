"""Splitmix64 and xoshiro256++ on arrays: one stream for each row, wrapping 64-bit arithmetic."""

from __future__ import annotations

import numpy as np

U = np.uint64
# Fixed values of the public algorithms and of the synthetic data set.
GOLDEN = U(0x9E3779B97F4A7C15)
MIX_1 = U(0xBF58476D1CE4E5B9)
MIX_2 = U(0x94D049BB133111EB)
CENTER_SALT = U(0xD1B54A32D192ED03)
QUERY_SALT = U(0x99991234ABCD0001)
QUERY_STEP = U(0x100000001B3)
COARSE_SALT, PQ_SALT = 0xC0FFEE, 0xBEEF
IRWIN_HALL_SCALE = np.float32(1.7320508)


def mixed(state: np.ndarray) -> np.ndarray:
    """The output of splitmix64 whose state has just become ``state``."""
    z = (state ^ state >> U(30)) * MIX_1
    z = (z ^ z >> U(27)) * MIX_2
    return z ^ z >> U(31)


class Streams:
    """Independent xoshiro256++ generators."""

    def __init__(self, seeds: np.ndarray):
        with np.errstate(over="ignore"):
            seeds = np.atleast_1d(np.asarray(seeds, U))
            self.state = [mixed(seeds + GOLDEN * U(k)) for k in range(1, 5)]

    def words(self) -> np.ndarray:
        a, b, c, d = self.state
        with np.errstate(over="ignore"):
            turn = lambda x, n: x << U(n) | x >> U(64 - n)
            out = turn(a + d, 23) + a
            c, d, shifted = c ^ a, d ^ b, b << U(17)
            self.state = [a ^ d, b ^ c, c ^ shifted, turn(d, 45)]
        return out

    def uniform(self) -> np.ndarray:
        """float32 in [0, 1) from the top 24 bits."""
        return (self.words() >> U(40)).astype(np.float32) * np.float32(2.0**-24)

    def symmetric(self) -> np.ndarray:
        return self.uniform() * np.float32(2) - np.float32(1)

    def bell(self) -> np.ndarray:
        """Roughly normal: four uniforms, centred and scaled."""
        total = self.uniform()
        for _ in range(3):
            total = total + self.uniform()
        return (total - np.float32(2)) * IRWIN_HALL_SCALE

    def below(self, bound: int) -> np.ndarray:
        """High word of the 128-bit product with ``bound``, from 32-bit halves."""
        x, half, low = self.words(), U(32), U(0xFFFFFFFF)
        with np.errstate(over="ignore"):
            b = U(bound)
            carry = ((x & low) * (b & low)) >> half
            middle = (x >> half) * (b & low) + carry
            side = (x & low) * (b >> half) + (middle & low)
            return (x >> half) * (b >> half) + (middle >> half) + (side >> half)


def vector_seeds(seed: int, ids: np.ndarray) -> np.ndarray:
    """Second splitmix64 output of each id's own state."""
    with np.errstate(over="ignore"):
        return mixed((U(seed) ^ np.asarray(ids, U) * GOLDEN) + GOLDEN * U(2))
