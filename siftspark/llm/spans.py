"""Spans within a text."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable


def apart(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (priority, start, end) those that overlap none of an earlier priority, or of the same and an earlier start; by start.

    Of two with one start the longer stays. Sorting and a search in what is taken for each, so texts may have any number.
    """
    taken: list[tuple[int, int, int]] = []
    for priority, start, end in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        i = bisect_right(taken, (start, end, priority))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            insort(taken, (start, end, priority))
    return [(priority, start, end) for start, end, priority in taken]
