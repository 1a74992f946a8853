"""Averaged perceptron over sparse named features."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence


class Perceptron:
    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, feats: Iterable[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in feats:
            for label, w in self.weights.get(f, {}).items():
                out[label] += w
        return out

    def train(self, data: Sequence[tuple[list[str], str]], rounds: int, labels: Sequence[str]) -> Perceptron:
        """Passes over the data in the given order; the weights are averaged over all steps."""
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = {}
        step, rank = 0, {label: k for k, label in enumerate(labels)}

        def change(f: str, label: str, by: float) -> None:
            w = self.weights.setdefault(f, {})
            old = w.get(label, 0.0)
            total[f, label] += old * (step - stamp.get((f, label), 0))
            stamp[f, label] = step
            w[label] = old + by

        for _ in range(rounds):
            for feats, label in data:
                step += 1
                s = self.scores(feats)
                # The first of the best labels. One without a score counts as 0; only the first such is looked for.
                low, at = min(((-v, rank[x]) for x, v in s.items()), default=(math.inf, 0))
                if low >= 0 and (k := next((k for k, x in enumerate(labels) if x not in s), None)) is not None:
                    low, at = min((low, at), (0.0, k))
                said = labels[at]
                if said != label:
                    for f in feats:
                        change(f, label, 1.0)
                        change(f, said, -1.0)
        for (f, label), t in total.items():
            w = self.weights[f]
            w[label] = (t + w[label] * (step - stamp[f, label])) / max(1, step)
        return self
