"""The k best rows of many questions, gathered batch by batch inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The ``k`` best (score, number) of each of ``n`` questions: scores rounded to nine decimals, higher ones first, ties to the smaller number.

    What a task holds are k rows a question, however many rows it reads and however many of them tie.
    """

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.numbers = [np.empty(0)] * n, [np.empty(0, np.int64)] * n

    def add(self, question: int, scores: np.ndarray, numbers: np.ndarray) -> None:
        """The scores of a batch, whose ``numbers`` ascend."""
        held, k = self.scores[question], self.k
        low = held[-1] if len(held) == k else -np.inf
        at = np.flatnonzero(scores > low - 1e-9)
        s = np.round(scores[at], 9)
        wins = (s > low) | ((s == low) & (numbers[at] < self.numbers[question][-1])) if len(held) == k else np.ones(len(s), bool)
        if not wins.any():
            return
        at, s = at[wins], s[wins]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            over, tied = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
            some = np.concatenate([over, tied[: k - len(over)]])
            at, s = at[some], s[some]
        s, o = np.concatenate([held, s]), np.concatenate([self.numbers[question], numbers[at]])
        first = np.lexsort((o, -s))[:k]
        self.scores[question], self.numbers[question] = s[first], o[first]

    def rows(self, names: tuple[str, str, str], ids: pa.Array, step: int = 2_000):
        """Batches of (question's id, number, score)."""
        for a in range(0, len(self.scores), step):
            counts = [len(s) for s in self.scores[a : a + step]]
            at = np.repeat(np.arange(a, a + len(counts)), counts)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate(self.numbers[a : a + step])), pa.array(np.concatenate(self.scores[a : a + step]))], names=list(names))
