"""Leaf order of a single-linkage tree."""

from __future__ import annotations

import numpy as np


def linkage_order(distance: np.ndarray) -> list[int]:
    """Merges the two nearest clusters until one is left; a cluster's leaves stay next to each other."""
    clusters = [[k] for k in range(len(distance))]
    while len(clusters) > 1:
        best = min(((min(distance[i, j] for i in a for j in b), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y), key=lambda t: t)
        _, x, y = best
        clusters = [c for k, c in enumerate(clusters) if k not in (x, y)] + [clusters[x] + clusters[y]]
    return clusters[0] if clusters else []
