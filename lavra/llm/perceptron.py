"""Averaged perceptrons over string features."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable


class Perceptron:
    """Multi-class averaged perceptron; ties go to the first label."""

    def __init__(self, labels: Iterable[str]):
        self.labels = sorted(set(labels))
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str]) -> dict[str, float]:
        total = dict.fromkeys(self.labels, 0.0)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                total[label] += w
        return total

    def predict(self, features: list[str]) -> str:
        total = self.scores(features)
        return max(self.labels, key=lambda x: total[x])

    def train(self, examples: list[tuple[list[str], str]], rounds: int = 5, seed: int = 7) -> "Perceptron":
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        sums: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.weights, step, order = weights, 0, list(range(len(examples)))
        shuffled = random.Random(seed)
        for _ in range(rounds):
            shuffled.shuffle(order)
            for k in order:
                features, truth = examples[k]
                step += 1
                guess = self.predict(features)
                if guess != truth:
                    for f in features:
                        # The running sums are of weight x steps still to come, so that the mean needs no pass of its own.
                        weights[f][truth] += 1.0
                        weights[f][guess] -= 1.0
                        sums[f][truth] += step
                        sums[f][guess] -= step
        self.weights = {f: mean for f, w in weights.items() if (mean := {x: v - sums[f][x] / max(step, 1) for x, v in w.items() if abs(v - sums[f][x] / max(step, 1)) > 1e-9})}
        return self
