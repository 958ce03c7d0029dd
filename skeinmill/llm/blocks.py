"""Links inside one pair of blocks, reduced to what connects them."""

from __future__ import annotations

import numpy as np


def local_components(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a bipartite link matrix: row numbers, and the rows' count plus
    column numbers; with ``same`` rows and columns are the same vectors."""
    n, m = link.shape
    r, c = np.nonzero(link)
    up = np.arange(n if same else n + m)
    c = c if same else c + n
    while True:
        low = np.minimum(up[r], up[c])
        new = up.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == up).all():
            return (up, up) if same else (up[:n], up[n:])
        up = new


def spanning_edges(link: np.ndarray, same: bool, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component within the pair) that connect what ``link`` connects."""
    up_a, up_b = local_components(link, same)
    ids, label = (ids_a, up_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([up_a, up_b]))
    smallest = np.full(len(ids_a) if same else len(ids_a) + len(ids_b), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    edge = smallest[label] != ids
    return ids[edge], smallest[label][edge]
