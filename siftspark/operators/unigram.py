"""A unigram tokenizer: of all ways to cut a text into pieces, the one whose pieces have the highest sum of scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

#: How much less an unknown character scores than the rarest piece.
UNKNOWN_PENALTY = 10.0


class Unigram:
    def __init__(self, pieces: Mapping[str, float], unknown_id: int = 0) -> None:
        """``pieces`` with their scores, in the order of their ids."""
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.scores = dict(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = unknown_id

    def cut(self, text: str) -> list[str]:
        """The best pieces; unknown characters in a row are one piece. Of equal ways, the one whose last pieces are longer. Empty for the empty text."""
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(text[start:end])
                if score is None and end - start == 1:
                    score = self.unknown
                if score is not None and best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, start)
        out: list[str] = []
        end = len(text)
        while end:
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return list(self._fused(out[::-1]))

    def _fused(self, pieces: list[str]) -> Iterator[str]:
        held = ""
        for p in pieces:
            if p in self.ids:
                if held:
                    yield held
                    held = ""
                yield p
            else:
                held += p
        if held:
            yield held

    def encode(self, text: str) -> list[int]:
        return [self.ids.get(p, self.unknown_id) for p in self.cut(text)]
