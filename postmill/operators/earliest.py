"""Which texts are similar (difflib ratio) to one of a few kept texts, decided for a batch at a time.

difflib decides; two bounds that lose nothing come first. A pair that matches in ``M`` of ``T`` characters shares at
least ``3M - T - 1`` character pairs, counted with repeats (see ``fuzzy.py``), and has a common subsequence of ``M``.
The kept text that shares most is tried first, so that a copy mostly costs one comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

#: Counters for hashed character pairs; a clash only raises the number in common.
SLOTS = 512
PAIRS_AT_ONCE = 1 << 15
WORD = 64
#: Longer texts have their common subsequence worked out one pair at a time.
LONG = 1_024


def masks(text: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence with a text of ``size``; matching blocks never cover more."""
    full = (1 << size) - 1
    state = full
    for c in text:
        hit = state & masks.get(c, 0)
        state = (state + hit | state - hit) & full
    return size - state.bit_count()


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in turn, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(x) for x in texts], np.int64)


def _pair_counts(texts: Sequence[str]) -> np.ndarray:
    """A row of counters per text; repeats of a character pair are numbered and counted apart."""
    points, sizes = _points(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[1:] == owner[:-1]
    own, pair = owner[1:][inside], ((points[:-1].astype(np.uint64) << np.uint64(21)) | points[1:])[inside]
    order = np.lexsort((pair, own))
    own, pair = own[order], pair[order]
    opens = np.ones(len(own), bool)
    opens[1:] = (own[1:] != own[:-1]) | (pair[1:] != pair[:-1])
    place = np.arange(len(own))
    nth = place - np.maximum.accumulate(np.where(opens, place, 0))
    mixed = (pair * np.uint64(0x9E3779B97F4A7C15)) ^ (nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    slot = ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 9)).astype(np.int64)
    return np.bincount(own * SLOTS + slot, minlength=len(texts) * SLOTS).reshape(-1, SLOTS).astype(np.float32)


class Kept:
    """Kept texts, prepared for being compared with many."""

    def __init__(self, texts: Sequence[str], threshold: float) -> None:
        self.texts, self.t = list(texts), threshold
        self.counts = _pair_counts(self.texts)
        self.matchers: dict[int, SequenceMatcher] = {}
        points, self.sizes = _points(self.texts)
        owner = np.repeat(np.arange(len(self.texts)), self.sizes)
        short = self.sizes[owner] <= LONG
        at, owner, points = (np.arange(len(points)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes))[short], owner[short], points[short]
        self.known = np.unique(points)
        words = max(1, -(-int(at.max(initial=-1) + 1) // WORD))
        # By word, text and character: where it stands, as bits. The last character stands for all unknown ones.
        self.bits = np.zeros((words, len(self.texts), len(self.known) + 1), np.uint64)
        bit = np.uint64(1) << (at % WORD).astype(np.uint64)
        np.bitwise_or.at(self.bits, (at // WORD, owner, np.searchsorted(self.known, points)), bit)

    def _codes(self, texts: Sequence[str]) -> np.ndarray:
        """Numbers of the characters by place and text, so that a step reads one line."""
        points, sizes = _points(texts)
        codes = np.full((int(sizes.max(initial=0)), len(texts)), len(self.known), np.int32)
        if len(self.known):
            at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
            codes[at, np.repeat(np.arange(len(texts)), sizes)] = np.where(self.known[found] == points, found, len(self.known))
        return codes

    def _common(self, codes: np.ndarray, row: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair: ``common`` for many at a time."""
        state = [np.full(len(row), ~np.uint64(0)) for _ in self.bits]
        for line in codes:
            code, carry = line[row], np.uint64(0)
            for k, bits in enumerate(self.bits):
                hit = state[k] & bits[kept, code]
                total = state[k] + hit
                over = total < hit
                total += carry
                over |= total < carry
                state[k] = total | (state[k] & ~hit)
                carry = over.astype(np.uint64)
        # Bits beyond a text's end have no mask, but a carry may reach them.
        out = np.zeros(len(row), np.int64)
        for k, left in enumerate(state):
            used = np.clip(self.sizes[kept] - k * WORD, 0, WORD)
            within = np.where(used == WORD, ~np.uint64(0), (np.uint64(1) << (used % WORD).astype(np.uint64)) - np.uint64(1))
            out += used - np.bitwise_count(left & within)
        return out

    def matches(self, text: str, k: int) -> bool:
        if k not in self.matchers:
            self.matchers[k] = SequenceMatcher(None, "", self.texts[k])
        self.matchers[k].set_seq1(text)
        return self.matchers[k].ratio() >= self.t

    def similar(self, texts: Sequence[str]) -> np.ndarray:
        """Does each text reach the threshold with any kept one?"""
        done = np.zeros(len(texts), bool)
        if not len(texts) or not self.texts:
            return done
        sizes = np.array([len(x) for x in texts], np.int64)
        total = sizes[:, None] + self.sizes[None, :]
        shared = _pair_counts(texts) @ self.counts.T
        able = shared >= (1.5 * self.t - 1) * total - 1 - 1e-6
        able &= 2 * np.minimum(sizes[:, None], self.sizes[None, :]) >= (self.t - 1e-9) * total
        best = np.where(able, shared / np.maximum(total, 1), -1).argmax(axis=1)
        for i in np.flatnonzero(able.any(axis=1)).tolist():
            done[i] = self.matches(texts[i], int(best[i]))
        able[np.arange(len(texts)), best] = False
        row, kept = np.nonzero(able & ~done[:, None])
        if not len(row):
            return done
        codes = self._codes([x if len(x) <= LONG else "" for x in texts])
        for start in range(0, len(row), PAIRS_AT_ONCE):
            x, y = row[start : start + PAIRS_AT_ONCE], kept[start : start + PAIRS_AT_ONCE]
            most = self._common(codes, x, y)
            for k in np.flatnonzero(np.maximum(sizes[x], self.sizes[y]) > LONG).tolist():
                most[k] = common(masks(self.texts[y[k]]), len(self.texts[y[k]]), texts[x[k]])
            likeness = 2 * most / np.maximum(total[x, y], 1)
            order = np.argsort(-likeness, kind="stable")
            for k in order[likeness[order] >= self.t - 1e-9].tolist():
                i = int(x[k])
                if not done[i]:
                    done[i] = self.matches(texts[i], int(y[k]))
        return done


def first_wins(texts: Sequence[str], threshold: float) -> list[bool]:
    """Is each text kept by the rule: similar to no earlier kept one?"""
    counts, sizes = _pair_counts(texts), np.array([len(x) for x in texts], np.int64)
    shared, kept = counts @ counts.T, np.zeros(len(texts), bool)
    one = Kept(texts, threshold)
    places = [masks(x) for x in texts]
    for i, text in enumerate(texts):
        total = sizes + sizes[i]
        able = kept & (shared[i] >= (1.5 * threshold - 1) * total - 1 - 1e-6)
        rows = np.flatnonzero(able & (2 * np.minimum(sizes, sizes[i]) >= (threshold - 1e-9) * total))
        kept[i] = not any(
            2 * common(places[k], len(texts[k]), text) >= (threshold - 1e-9) * int(total[k]) and one.matches(text, k)
            for k in rows[np.argsort(-shared[i][rows], kind="stable")].tolist()
        )
    return kept.tolist()
