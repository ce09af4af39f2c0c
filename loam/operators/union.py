"""Connected components of a bounded number of edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edges (16 bytes each) that one task may unite.
ONE_TASK = 1_000_000


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in order, and the least node that each is linked to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    unite(parent, one, two)
    return nodes, nodes[parent]


def unite(parent: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Link the places in two arrays, in ``parent``, where each place then has the least that it is linked to."""
    while len(one):
        a, b = parent[one], parent[two]
        apart = a != b
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((above := parent[parent]) != parent).any():
            parent[:] = above


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[c.to_numpy() for c in batch.columns[:2]] for batch in batches]
    none = np.zeros(0, np.int64)
    nodes, roots = united(*(np.concatenate([none, *(e[k] for e in ends)]) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])


def united_edges(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of two columns of long ids without nulls; for ``ONE_TASK`` edges at most."""
    return edges.coalesce(1).mapInArrow(_united, "node long, component long")
