"""A plain statement of the Katz model, for tests."""

from collections import Counter, defaultdict
from math import log10

import numpy as np

from deltaloom.llm import katz


class Plain:
    """Counts of the training rows and probabilities of any order, by recursion over the history."""

    def __init__(self, seqs, order=3):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        self.after = defaultdict(dict)
        for s in seqs:
            padded = [*[1] * (order - 1), *s]
            for i, w in enumerate(s):
                for m in range(1, order + 1):
                    self.counts[m][tuple(padded[i + order - m : i + order])] += 1
        self.uni = Counter({k[0]: c for k, c in self.counts[1].items()})
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.z = self.n + katz.SMOOTH * (self.v + 1)
        self.d = {}
        for m in range(2, order + 1):
            r = np.bincount([c for c in self.counts[m].values() if c <= katz.K + 1] or [0], minlength=katz.K + 2)
            r[0] = 0
            self.d[m] = katz.discounts(r)
            for gram, c in self.counts[m].items():
                self.after[gram[:-1]][gram[-1]] = c

    def cut(self, c, m):
        return c * (self.d[m][c - 1] if c <= katz.K else 1)

    def prob(self, history, w):
        if not history:
            return (self.uni[w] + katz.SMOOTH) / self.z
        own, m = self.after.get(history), len(history) + 1
        if not own:
            return self.prob(history[1:], w)
        total = sum(own.values()) + all(c > katz.K for c in own.values())
        if w in own:
            return self.cut(own[w], m) / total
        left = 1 - sum(self.cut(c, m) for c in own.values()) / total
        return left / (1 - sum(self.prob(history[1:], x) for x in own)) * self.prob(history[1:], w)


def score(rows, order=3):
    """{row number: (held_out, n_tokens, n_known, N, base, score)} for rows of (doc_id, text), and the model."""
    seqs = [[*katz.tokens(t), None] for _, t in rows]
    model = Plain([s for (i, _), s in zip(rows, seqs) if not katz.held_out(i)], order)
    out = {}
    for k, ((i, _), s) in enumerate(zip(rows, seqs)):
        padded = [*[1] * (order - 1), *s]
        logs = [log10(model.prob(tuple(padded[j : j + order - 1]), w)) for j, w in enumerate(s)]
        out[k] = (katz.held_out(i), len(s), sum(model.uni[w] > 0 for w in s), model.n, sum(log10(model.prob((), w)) for w in s), sum(logs))
    return out, model
