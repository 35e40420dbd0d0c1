"""Plain versions that several tests share."""

import numpy as np


def covered(texts, n=200):
    """Marks of the bytes of each text that strings of n bytes cover which start elsewhere too."""
    seen = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k : k + n], []).append((i, k))
    marks = [np.zeros(len((t or "").encode()), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                marks[i][k : k + n] = True
    return marks


def plain_components(texts):
    """The least index reachable over pairs whose sets of 5-word shingles have Jaccard similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in texts:
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(texts))]
    return least
