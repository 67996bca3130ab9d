"""Vector arithmetic used inside tasks.

Shipped to the workers by value, so they need numpy and Arrow only and not
this package on their path.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Cosine distances carry noise of about 1e-15; digits beyond these say nothing.
COSINE_DIGITS = 12
# Entries of one distance block, and candidates, held in memory at a time.
BLOCK_ENTRIES = 2_000_000
PENDING = 1_000_000
# Slack of comparisons made with rounding errors; what lies within it is measured again exactly.
SLACK = 1e-9

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix_of(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with the right length and finite values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1)
    right = np.asarray(lengths) == dimensions
    kept = column.filter(pa.array(right))
    flat = kept.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)
    return values[finite], np.flatnonzero(right)[finite]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, whatever their size; zero vectors stay zero."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    small = vectors / np.where(largest > 0, largest, 1.0)[:, None]
    length = np.sqrt((small ** 2).sum(axis=1))
    return small / np.where(length > 0, length, 1.0)[:, None]


def distances_to(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each pair of rows; for cosine, both hold unit vectors.

    A pair's distance does not depend on the rows around it, so copies tie.
    """
    square = ((vectors - queries) ** 2).sum(axis=1)
    if metric == "l2":
        return np.sqrt(square)
    nothing = ~(vectors.any(axis=1) & queries.any(axis=1))
    return np.round(np.where(nothing, 1.0, square / 2), COSINE_DIGITS)


class Leaders:
    """Best k candidates per query over the batches of one task.

    Rows are taken cell by cell, a cell being the rows nearest to one pivot.
    By the triangle inequality no row of a cell is nearer to a query than the
    pivot is, less the cell's radius; cells beyond a query's k-th best are
    left out for it. Distances to the pivots, which are rows too, give the
    first k-th best if there are k of them.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, pivots: np.ndarray | None = None):
        self.k, self.metric = k, metric
        self.queries = unit(queries) if metric == "cosine" else queries
        self.pivots = np.zeros((0, queries.shape[1])) if pivots is None else pivots
        if metric == "cosine":
            self.pivots = unit(self.pivots)
        self.to_pivots = self._reach(self.pivots, self.queries)
        self.limits = np.full(len(queries), np.inf)
        if 0 < k <= len(self.pivots) and (metric == "l2" or self.pivots.any(axis=1).all()):
            self.limits = np.partition(self.to_pivots, k - 1, axis=1)[:, k - 1] + SLACK
        with np.errstate(over="ignore"):
            self.squares = (self.queries ** 2).sum(axis=1)
        self.long = np.column_stack([self.queries, np.ones(len(queries))])
        self.pending, self.waiting = [], 0

    @staticmethod
    def _reach(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Euclidean distances up to rounding errors, one row per query."""
        with np.errstate(over="ignore", invalid="ignore"):
            square = (rows ** 2).sum(axis=1)[None, :] + (queries ** 2).sum(axis=1)[:, None] - 2.0 * (queries @ rows.T)
        # What is too large to square is measured exactly later.
        return np.sqrt(np.maximum(np.nan_to_num(square, nan=0.0, posinf=0.0, neginf=0.0), 0.0))

    def _slack(self, rows: np.ndarray) -> float:
        if self.metric == "cosine":
            # Distances that round alike tie; near 0 their roots differ by up to a millionth.
            return 2e-6
        with np.errstate(over="ignore"):
            return 1e-6 * sum(np.sqrt((m ** 2).sum(axis=1).max(initial=0.0)) for m in (rows, self.queries))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = unit(vectors) if self.metric == "cosine" else vectors
        slack = self._slack(rows)
        if len(self.pivots) and np.isfinite(slack):
            away = self._reach(rows, self.pivots)
            cell = np.argmin(away, axis=0)
            order = np.argsort(cell, kind="stable")
            found, starts = np.unique(cell[order], return_index=True)
            for pivot, members in zip(found, np.split(order, starts[1:])):
                radius = away[pivot, members].max()
                near = np.flatnonzero(self.to_pivots[:, pivot] - radius <= self.limits + slack)
                self._add_cell(ids[members], rows[members], near, slack)
        else:
            self._add_cell(ids, rows, np.arange(len(self.queries)), slack)

    def _add_cell(self, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, slack: float) -> None:
        step = max(1, BLOCK_ENTRIES // max(1, len(asked)))
        every = len(asked) == len(self.queries)
        queries, squares = (self.long, self.squares) if every else (self.long[asked], self.squares[asked])
        # A row is within reach if q.r - r.r / 2 >= (q.q - reach^2) / 2: one product, with one more column, and one test.
        with np.errstate(over="ignore"):
            long = np.column_stack([rows, (rows ** 2).sum(axis=1) / -2.0])
        for start in range(0, len(ids) if len(asked) else 0, step):
            some = rows[start:start + step]
            if np.isfinite(slack):
                with np.errstate(over="ignore"):
                    bar = (squares - (self.limits[asked] + slack) ** 2) / 2.0
                near = queries @ long[start:start + step].T >= bar[:, None]
            else:
                near = self._reach(some, self.queries[asked]) <= (self.limits[asked] + slack)[:, None]
            if self.metric == "cosine":
                # Zero vectors have distance 1 to everything.
                near[:, ~some.any(axis=1)] = True
            query, row = np.divmod(np.flatnonzero(near), len(some))
            for low in range(0, len(query), PENDING):
                q, r = asked[query[low:low + PENDING]], row[low:low + PENDING]
                exact = np.concatenate([distances_to(some[r[i:i + 16384]], self.queries[q[i:i + 16384]], self.metric)
                                        for i in range(0, len(q), 16384)])
                self.pending.append((q, ids[start + r], exact))
                self.waiting += len(q)
                if self.waiting > PENDING:
                    self._settle()

    def _settle(self) -> None:
        """Keep the k smallest (distance, id) pairs of every query."""
        if not self.pending:
            return
        query, ids, distance = (np.concatenate(parts) for parts in zip(*self.pending))
        order = np.argsort(ids, kind="stable")
        order = order[np.lexsort((distance[order], query[order]))]
        query, ids, distance = query[order], ids[order], distance[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        last = rank == self.k - 1
        worst = np.sqrt(2 * distance[last]) if self.metric == "cosine" else distance[last]
        self.limits[query[last]] = np.minimum(self.limits[query[last]], worst + SLACK)
        self.pending, self.waiting = [(query[kept], ids[kept], distance[kept])], 0

    def rows(self):
        """Query numbers, ids and distances."""
        self._settle()
        return self.pending[0] if self.pending else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))


def id_values(column) -> np.ndarray:
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy()
    return np.array(column.to_pylist(), dtype=object)
