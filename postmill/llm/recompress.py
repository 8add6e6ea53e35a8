"""Recompression of word sequences: equal stretches get equal symbols inside.

A round first joins runs of one symbol (in the first round), then pairs ``ab`` where a hash puts ``a``
into the left and ``b`` into the right half of the alphabet. Names are hashes of what they join, so equal
pairs are named alike in every task and every document without a table of names. Each symbol also knows
the stretch of words that fixed it: itself and the neighbours that were looked at. Wherever that stretch
occurs, the symbol occurs in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from postmill.llm.words import mix

ROUNDS = 4
LONGEST = 12

_LEFT, _RIGHT, _NEITHER = 0, 1, 2


class Symbols(NamedTuple):
    """Symbols in order: name, first word, number of words, and the stretch ``[low, high)`` that fixed them."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wall: np.ndarray


def _runs(s: Symbols) -> Symbols:
    """Joins runs of equal symbols; every symbol was fixed by its neighbours too, which differ."""
    n = len(s.name)
    same = (s.name[1:] == s.name[:-1]) & ~s.wall[1:] & ~s.wall[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([first[1:], [n]]) - 1
    count = last - first + 1
    name = np.where(count > 1, mix(s.name[first] + mix(count.astype(np.uint64))), s.name[first])
    return Symbols(
        name, s.start[first], s.start[last] + s.size[last] - s.start[first],
        s.low[np.maximum(first - 1, 0)], s.high[np.minimum(last + 1, n - 1)], s.wall[first],
    )


def _pairs(s: Symbols, salt: int, longest: int) -> Symbols:
    half = (mix(s.name ^ np.uint64(0xA5A5A5A5 + salt)) & np.uint64(1)).astype(np.int8)
    half[s.wall] = _NEITHER
    joined = np.zeros(len(half) + 1, bool)  # joined[i]: symbols i - 1 and i are one
    joined[1:-1] = (half[:-1] == _LEFT) & (half[1:] == _RIGHT) & (s.size[:-1] + s.size[1:] <= longest)
    first = np.flatnonzero(~joined[:-1])
    two = joined[first + 1]
    last = first + two
    n = len(half) - 1
    name = np.where(two, mix(s.name[first] * np.uint64(0x9E3779B97F4A7C15) + mix(s.name[last] ^ np.uint64(salt + 1))), s.name[first])
    # A single left symbol looked at what follows, a right one at what precedes; a wall is fixed by itself.
    before = np.where(~two & (half[first] == _RIGHT), np.maximum(first - 1, 0), first)
    after = np.where(~two & (half[first] == _LEFT), np.minimum(last + 1, n), last)
    return Symbols(
        name, s.start[first], s.start[last] + s.size[last] - s.start[first],
        np.minimum(s.low[before], s.low[first]), np.maximum(s.high[after], s.high[last]), s.wall[first],
    )


def recompress(words: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> Symbols:
    """Symbols of a word sequence; words at ``wall`` places part documents and join with nothing."""
    at = np.arange(len(words))
    s = Symbols(words, at, np.ones(len(words), np.int64), at, at + 1, wall)
    if not len(words):
        return s
    s = _runs(s)
    for k in range(rounds):
        s = _pairs(s, k, longest)
    return s


def anchors(s: Symbols, n_words: int, window: int) -> np.ndarray:
    """For each window start the place in ``s`` of the window's anchor; -1 where it has none.

    A window's anchor is the longest symbol that is fixed inside it (ties: smallest name, leftmost): a
    function of the window's words alone, so equal windows have equal anchors at equal places in them.
    """
    usable = np.flatnonzero(~s.wall & (s.high - s.low <= window))
    low, high = np.maximum(s.high[usable] - window, 0), s.low[usable]
    longest_first = np.uint64(255) - np.minimum(s.size[usable], 255).astype(np.uint64)
    order = np.argsort(longest_first << np.uint64(56) | s.name[usable] >> np.uint64(8), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    best = np.full(n_words, len(order), np.int64)
    for k in range(window):
        inside = low + k <= high
        low, high, place = low[inside], high[inside], place[inside]
        np.minimum.at(best, low + k, place)
    return np.append(usable[order], -1)[best]
