"""Signatures for a set similarity join: parts of the feature domain, and subsets of parts.

Two sets with Jaccard similarity of at least ``num / den`` differ in at most
``(den - num) * (|s| + |t|) // (den + num)`` features. Sizes are cut into bands, and a pair is
looked for in the band of its smaller set. There the feature domain is cut into parts; a part
together with the features a set has in it is a token. Each differing feature spoils one token
of a set at most, so of ``h + c`` tokens of a set, ``c`` are also tokens of any partner that
differs from it in ``h`` features. All subsets of ``c`` of its first ``h + c`` tokens, in an order
that both sets share, are its signatures: partners have one in common. A set with too few tokens
gets one more signature that all such sets of its band share.

The shared order only decides how selective the signatures are: features known to be frequent
form parts of their own, which come last, and tokens of more features come first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from cellwarden.llm.textbatch import U64, mix

_BAND = U64(0xD6E8FEB86659FD93)
#: Sets per call, as a set's number is part of a 64-bit sort key.
MOST_SETS = 1 << 18


class Bands:
    """Size bands and their numbers of parts for a similarity of ``num / den`` or more."""

    def __init__(self, num: int = 3, den: int = 4, growth: int = 2, fine: int = 8):
        self.num, self.den, self.growth, self.fine = num, den, growth, fine
        if not 0 < num <= den or growth * num < den:
            raise ValueError("need 0 < num <= den and bands that only reach the next one")

    def largest(self, size: np.ndarray) -> np.ndarray:
        """Most features a partner of a set of ``size`` features can have."""
        return size * self.den // self.num

    def differ(self, both: np.ndarray) -> np.ndarray:
        """Most features that differ in a pair with ``both`` features in all."""
        return (self.den - self.num) * both // (self.den + self.num)

    def band(self, size: np.ndarray) -> np.ndarray:
        """Number of the band: the sizes from growth**b to growth**(b+1) - 1."""
        edges = self.growth ** np.arange(1, int(63 / np.log2(self.growth)), dtype=np.int64)
        return np.searchsorted(edges, size, "right")

    def roles(self, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which sets, band, differing features): as members of a band, and as partners of the one below."""
        band = self.band(size)
        every = np.arange(len(size))
        own = (every, band, self.differ(size + self.largest(size)))
        top = self.growth**band - 1  # largest size of the band below
        above = every[(band > 0) & (size <= self.largest(top))]
        return [own, (above, band[above] - 1, self.differ(size[above] + top[above]))]

    def parts(self, band: np.ndarray) -> np.ndarray:
        """Parts of the domain: some more than the tokens needed, as a few of them stay empty."""
        top = self.growth ** (band + 1) - 1
        return self.differ(top + self.largest(top)) * 6 // 5 + 3

    def is_fine(self, band: np.ndarray) -> np.ndarray:
        """Bands of small sets: every feature is a part of its own, and signatures take two."""
        return self.growth ** (band + 1) <= self.fine


def signatures(
    features: np.ndarray, sets: np.ndarray, sizes: np.ndarray, bands: Bands, frequent: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many sets, and the number of the set each belongs to.

    ``features`` holds distinct 64-bit hashes, ascending inside each set; ``sets`` the number of
    their set, ascending; ``sizes`` the features of each set. ``frequent`` is sorted.
    """
    if len(sizes) > MOST_SETS:
        raise ValueError(f"at most {MOST_SETS} sets at once")
    out, owner = [], []
    begins = np.cumsum(sizes) - sizes
    common = np.zeros(len(features), bool)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, features), len(frequent) - 1)
        common = frequent[at] == features
    mixed = mix(features ^ U64(0x2545F4914F6CDD1D))
    for which, band, apart in bands.roles(sizes):
        if not len(which):
            continue
        member = np.zeros(len(sizes), bool)
        member[which] = True
        band_of, apart_of = np.zeros((2, len(sizes)), np.int64)
        band_of[which], apart_of[which] = band, apart
        pick = np.flatnonzero(member[sets])
        s, f, rare = sets[pick], features[pick], ~common[pick]
        fine = bands.is_fine(band_of)[s]
        # Ascending hashes make ascending parts, so the features of a part lie side by side.
        part = ((f >> U64(32)) * bands.parts(band_of)[s].astype(U64)) >> U64(32)
        part = np.where(fine, f, part)
        order = np.argsort(s * 2 + ~rare, kind="stable") if not rare.all() else None
        value = mixed[pick]
        if order is not None:
            s, part, rare, value = s[order], part[order], rare[order], value[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1]) | (rare[1:] != rare[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(s)))
        token = mix(np.add.reduceat(value, first) ^ (part[first] * _BAND) ^ band_of[s[first]].astype(U64))
        ts, tr = s[first], rare[first]
        # Set (18 bits), frequent or not, features (falling, 9 bits), and 36 bits of the token.
        key = (ts.astype(U64) << U64(46)) | ((~tr).astype(U64) << U64(45))
        key |= (U64(511) - np.minimum(count, 511).astype(U64)) << U64(36)
        order = np.argsort(key | (token >> U64(28)))
        ts, token = ts[order], token[order]
        tokens = np.bincount(ts, minlength=len(sizes))
        start = np.cumsum(tokens) - tokens
        rank = np.arange(len(ts)) - start[ts]
        several = bands.is_fine(band_of) & (sizes > 1) & (bands.growth ** (band_of + 1) > 2)
        need = apart_of + np.where(several, 2, 1)
        short = member & (tokens < need)
        # One token a signature.
        single = (rank < need[ts]) & ~several[ts]
        out.append(token[single])
        owner.append(ts[single])
        # Two tokens a signature.
        for n in np.unique(need[several & member]):
            mine = np.flatnonzero(several & member & (need == n) & ~short)
            table = token[start[mine][:, None] + np.arange(n)]
            for a, b in combinations(range(n), 2):
                out.append(mix(table[:, a] + table[:, b] * U64(3) + (table[:, a] ^ table[:, b])))
                owner.append(mine)
        left = np.flatnonzero(short)
        out.append(mix(band_of[left].astype(U64) * _BAND + U64(77)))
        owner.append(left)
    return np.concatenate(out or [np.zeros(0, U64)]), np.concatenate(owner or [np.zeros(0, np.int64)])
