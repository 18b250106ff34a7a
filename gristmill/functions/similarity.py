"""String similarity on a 0-100 scale (indel distance family).

``ratio`` is 200 * LCS / (len(a) + len(b)).  The longest common subsequence is computed
with one machine-integer row per character, so a comparison costs one big-integer step per
character of the shorter side.  Before any of this, :func:`similarity_bound` tells from the
characters alone, as a column expression, how similar two texts can be at most.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Masks(dict):
    """For each text the places of its characters as bits, found once."""

    def __missing__(self, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        for index, char in enumerate(text):
            found[char] = found.get(char, 0) | (1 << index)
        self[text] = found
        return found


def _lcs(masks: dict[str, int], width: int, other: str) -> int:
    """Bit-parallel LCS length (Hyyrö 2004): zero bits of the row mark matched positions."""
    full = (1 << width) - 1
    row = full
    for char in other:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return width - row.bit_count()


def ratio(left: str, right: str, masks: Masks | None = None) -> float:
    total = len(left) + len(right)
    if not total:
        return 100.0
    return 200.0 * _lcs((Masks() if masks is None else masks)[left], len(left), right) / total


def _best_window(short: str, long: str, least: float, known: Masks) -> float:
    """The best ratio of ``short`` and a window of ``long``, if above ``least``."""
    masks, width, best = known[short], len(short), least
    missing, common = Counter(short), 0
    for start in range(1 - width, len(long)):
        if start + width <= len(long):
            char = long[start + width - 1]
            common += missing[char] > 0
            missing[char] -= 1
        if start > 0:
            char = long[start - 1]
            missing[char] += 1
            common -= missing[char] > 0
        window = long[max(start, 0):start + width]
        # The characters that both hold, in whatever order, bound the score of this window.
        if 200.0 * common / (width + len(window)) <= best:
            continue
        best = max(best, 200.0 * _lcs(masks, width, window) / (width + len(window)))
        if best == 100.0:
            break
    return best


def partial_ratio(left: str, right: str, least: float = 0.0, masks: Masks | None = None) -> float:
    """Best ratio of the shorter text against any window of the longer one; ``least`` if none is above it."""
    if not left or not right:
        return 100.0 if left == right else 0.0
    masks = Masks() if masks is None else masks
    short, long = sorted((left, right), key=len)
    best = _best_window(short, long, least, masks)
    if len(short) == len(long) and best < 100.0:
        best = _best_window(long, short, best, masks)
    return best


def token_sort_ratio(left: str, right: str, masks: Masks | None = None) -> float:
    return ratio(" ".join(sorted(left.split())), " ".join(sorted(right.split())), masks)


def best_similarity(left: str, right: str, least: float = 0.0, masks: Masks | None = None) -> float:
    """The best of the three ratios, as a share of one; exact where it is above ``least``."""
    best = ratio(left, right, masks)
    if best < 100.0:
        best = max(best, token_sort_ratio(left, right, masks))
    if best < 100.0:
        best = max(best, partial_ratio(left, right, max(best, 100.0 * least), masks))
    return best / 100.0


def closest(text: str, choices: Iterable[str]) -> tuple[str | None, float]:
    """The choice with the best partial ratio; the first one wins a tie."""
    best, best_score = None, -1.0
    for choice in choices:
        score = partial_ratio(text, choice)
        if score > best_score:
            best, best_score = choice, score
    return best, best_score


def characters(text: Column) -> Column:
    """A text's characters as a set, repeated ones told apart by number: what :func:`similarity_bound` compares."""
    ordered = F.array_sort(F.split(text, ""))
    return F.transform(ordered, lambda c, i: F.concat(c, (i - F.array_position(ordered, c)).cast("string")))


def squeezed_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.trim(text), " +", " "))


def similarity_bound(left: Column, right: Column, left_length: Column, right_length: Column) -> Column:
    """At most so similar are two texts, from their :func:`characters` and :func:`squeezed_length`.

    A common subsequence, also with a window or with words in another order, has at most the
    ``m`` characters that both texts hold; its partner is at least as long.  So no ratio is above
    ``2 * m / (length of the shorter + m)``.
    """
    common = F.size(F.array_intersect(left, right)).cast("double")
    return F.least(F.lit(1.0), 2.0 * common / (F.least(left_length, right_length) + common))
