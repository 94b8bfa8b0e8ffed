"""Words of UTF-8 text as 64-bit hashes, computed on whole byte arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

LONGEST = 1 << 12  # longer words are hashed one by one
# A multiplier for each place of a word and a value for each byte, drawn at random from a fixed key. Powers of one number
# would not do: modulo 2^64 there are words that collide for every base.
KEY = 20_260_731
_draw = np.random.default_rng(KEY)
POWERS = _draw.integers(0, 1 << 64, LONGEST, np.uint64) | np.uint64(1)
BYTES = _draw.integers(0, 1 << 64, 256, np.uint64)

WHITE = b" \t\n\v\f\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Byte classes; 0 separates tokens, and a token never spans two classes.
BLANK_SEPARATED = np.ones(256, np.uint8)
BLANK_SEPARATED[list(WHITE)] = 0
# Runs of letters, digits and non-ASCII bytes, and runs of other visible ASCII.
WORD_PUNCT = np.ones(256, np.uint8)
WORD_PUNCT[:128] = 2
WORD_PUNCT[48:58] = WORD_PUNCT[65:91] = WORD_PUNCT[97:123] = 1
WORD_PUNCT[list(WHITE)] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


@dataclass
class Tokens:
    """Tokens of consecutive texts. `bounds[i]:bounds[i + 1]` are the tokens of text i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = BLANK_SEPARATED, lower: bool = False) -> Tokens:
    """Tokens of the texts `data[offsets[i]:offsets[i + 1]]`; A-Z count as a-z if `lower`."""
    if lower:
        data = LOWER[data]
    kinds = classes[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        none = np.zeros(0, np.int64)
        return Tokens(none.astype(np.uint64), none, none, none.astype(np.uint8), np.zeros(len(offsets), np.int64))
    lengths = np.diff(cuts)
    kind = kinds[cuts[:-1]]
    inside = np.arange(len(data)) - np.repeat(cuts[:-1], lengths)
    long = lengths > LONGEST
    if long.any():
        np.minimum(inside, LONGEST - 1, out=inside)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(BYTES[data] * POWERS[inside], cuts[:-1])
        h = mix(h + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh3_64_intdigest(data[cuts[i] : cuts[i + 1]].tobytes())
    keep = kind > 0
    starts = cuts[:-1][keep]
    return Tokens(h[keep], starts, starts + lengths[keep], kind[keep], np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values from each position on; positions near the end wrap to zeros."""
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        total, power, shift = np.zeros_like(hashes), np.uint64(1), 0
        block, block_power, size = hashes.copy(), factor, 1
        rest = length
        while rest:
            if rest & 1:
                total = total + power * moved(block, shift)
                shift += size
                power = power * block_power
            rest >>= 1
            if rest:
                block = block + block_power * moved(block, size)
                block_power = block_power * block_power
                size *= 2
        return mix(total + np.uint64(length))


def moved(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def fits(bounds: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of `length` tokens from each position on stays inside its text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(len(ends)) + length <= ends
