"""Arrow kernels: score a block of queries against a block of rows, keep the best k.

A scorer turns query rows into a state once per task and then scores record batches:

    state = scorer.prepare(query_table)
    rows = scorer.load(state, batch)
    scores = scorer.score(state, rows, lo, hi)    # (hi - lo) x len(batch), -inf = no hit

Scores are rounded to 9 decimals before ranking so that summation order cannot change
an outcome; equal scores are ordered by row id.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DECIMALS = 9
_CELLS_PER_STEP = 4_000_000
_VALUES_PER_STEP = 8_000_000
_SCREENED_CELLS = 1_000_000  # single-precision scores at a time, so that they stay in the cache
_FIRST_ROWS = 512  # scored exactly before anything can be screened out
_CROWDED = 8  # one row in so many passing the screen: all of them are scored exactly


def array_matrix(column, dtype=np.float64) -> np.ndarray:
    """Arrow list column of equal-length vectors as a dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0), dtype)
    lengths = pc.list_value_length(column)
    widths = pc.min_max(lengths)
    if lengths.null_count or widths["min"] != widths["max"]:
        raise ValueError("vectors differ in length or are missing")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; zeros stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norm[norm == 0] = 1.0
    return matrix / norm[:, None]


class CosineScorer:
    """Cosine similarity; a zero vector is similar to nothing (0)."""

    def __init__(self, query_vector: str, row_vector: str):
        self.query_vector, self.row_vector = query_vector, row_vector

    def prepare(self, queries):
        return unit_rows(array_matrix(queries.column(self.query_vector)))

    def rows_per_step(self, state):
        return max(1, _VALUES_PER_STEP // max(state.shape[1], 1))

    def load(self, state, batch):
        return unit_rows(array_matrix(batch.column(self.row_vector)))

    def score(self, state, rows, lo, hi):
        return state[lo:hi] @ rows.T

    def margin(self, state):
        """More than a single-precision product of two unit rows can be away from their score."""
        return 2e-7 * (state.shape[1] + 16) + 10.0**-SCORE_DECIMALS

    def pairs(self, state, rows, r, c):
        """Scores of query rows ``r`` with rows ``c``."""
        out = np.empty(len(r))
        step = max(1, _VALUES_PER_STEP // 4 // max(state.shape[1], 1))
        for lo in range(0, len(r), step):
            part = slice(lo, lo + step)
            out[part] = np.einsum("ij,ij->i", state[r[part]], rows[c[part]])
        return out


class Bm25Scorer:
    """Sum over shared terms of query weight x saturated, length-normalised term count."""

    def __init__(self, terms, weights, row_tokens, mean_length, k1, b):
        self.terms, self.weights, self.row_tokens = terms, weights, row_tokens
        self.mean_length, self.k1, self.b = mean_length, k1, b

    @staticmethod
    def _lists(column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(column)), lengths), column.flatten(), lengths

    def prepare(self, queries):
        owner, terms, _ = self._lists(queries.column(self.terms))
        weights = self._lists(queries.column(self.weights))[1].to_numpy(zero_copy_only=False)
        vocabulary = terms.unique()
        matrix = np.zeros((queries.num_rows, max(len(vocabulary), 1)))
        np.add.at(matrix, (owner, pc.index_in(terms, vocabulary).to_numpy()), weights)
        return matrix, vocabulary

    def rows_per_step(self, state):
        return max(1, _VALUES_PER_STEP // state[0].shape[1])

    def load(self, state, batch):
        matrix, vocabulary = state
        width = matrix.shape[1]
        owner, tokens, lengths = self._lists(batch.column(self.row_tokens))
        codes = pc.fill_null(pc.index_in(tokens, vocabulary), -1).to_numpy(zero_copy_only=False)
        known = codes >= 0
        cells = owner[known] * width + codes[known]
        counts = np.bincount(cells, minlength=batch.num_rows * width)
        counts = counts.reshape(-1, width).astype(np.float64)
        norm = self.k1 * (1.0 - self.b + self.b * lengths / self.mean_length)
        return counts * (self.k1 + 1.0) / (counts + norm[:, None])

    def score(self, state, rows, lo, hi):
        scores = state[0][lo:hi] @ rows.T
        scores[scores <= 0] = -np.inf
        return scores


def _best_first(rows, scores, ids) -> np.ndarray:
    """Order by row number, score descending, then id; ids that are objects are compared only where scores tie."""
    if ids.dtype != object:
        return np.lexsort((ids, -scores, rows))
    order = np.lexsort((-scores, rows))
    r, s = rows[order], scores[order]
    same = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
    if not same.any():
        return order
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    at = order[tied]
    codes = np.unique(ids[at], return_inverse=True)[1]
    order[tied] = at[np.lexsort((codes, -s[tied], r[tied]))]
    return order


def keep_best(rows, scores, ids, k):
    """Best k entries per row number, by score descending then id."""
    if rows.size == 0:
        return rows, scores, ids
    order = _best_first(rows, scores, ids)
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    starts = np.flatnonzero(first)
    position = np.arange(rows.size) - np.repeat(starts, np.diff(np.append(starts, rows.size)))
    kept = position < k
    return rows[kept], scores[kept], ids[kept]


def best_cells(block, k):
    """Mask of the k best cells per row; of equal scores the first columns (smallest ids) stay.

    Any number of copies of a row costs one running count, not a sort.
    """
    found = block > -np.inf
    n = block.shape[1]
    if n <= k:
        return found
    floor = np.partition(block, n - k, axis=1)[:, n - k][:, None]
    hit = (block >= floor) & found
    if np.count_nonzero(hit) > k * len(block):
        above = block > floor
        room = k - np.count_nonzero(above, axis=1)[:, None]
        level = hit & ~above
        hit = above | (level & (np.cumsum(level, axis=1) <= room))
    return hit


def slices(batches, height, first=None):
    """Pieces of at most ``height`` rows; with ``first`` they begin that small and at most double what was seen."""
    seen = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            size = min(height, max(first, seen)) if first else height
            yield batch.slice(start, size)
            start, seen = start + size, seen + size


def _exact_cells(scorer, state, rows, lo, hi, k):
    """Query rows, rows and scores of the k best of every query in ``lo:hi``."""
    block = np.round(scorer.score(state, rows, lo, hi), SCORE_DECIMALS)
    block[np.isnan(block)] = -np.inf
    r, c = np.nonzero(best_cells(block, k))
    return r + lo, c, block[r, c]


def _screened_cells(scorer, state, thin, rows, least, k):
    """As ``_exact_cells`` of all queries, less what cannot reach ``least``, their k-th best scores so far.

    Single-precision scores rule rows out; the few that are left within their margin are scored exactly.
    """
    n = len(rows)
    turned = np.ascontiguousarray(rows.astype(np.float32).T)
    bound = (least - scorer.margin(state)).astype(np.float32)
    step = max(1, _SCREENED_CELLS // n)
    for lo in range(0, len(thin), step):
        near = thin[lo : lo + step] @ turned
        flat = np.flatnonzero(near >= bound[lo : lo + step, None])
        if flat.size == 0:
            continue
        r, c = flat // n, flat % n
        crowded = np.bincount(r, minlength=len(near)) > max(n // _CROWDED, k)
        if crowded.any():
            for q in np.array_split(np.flatnonzero(crowded), -(-np.count_nonzero(crowded) * n // _CELLS_PER_STEP)):
                found = _exact_cells(scorer, state[q + lo], rows, 0, len(q), k)
                yield q[found[0]] + lo, found[1], found[2]
            kept = ~crowded[r]
            r, c = r[kept], c[kept]
        r = r + lo
        scores = np.round(scorer.pairs(state, rows, r, c), SCORE_DECIMALS)
        kept = scores >= least[r]
        yield r[kept], c[kept], scores[kept]


def best_rows(scorer, state, n_queries, batches, id_column, k):
    """Running best-k over a stream of record batches; memory is one batch plus k per query.

    A scorer with a ``margin`` is asked for exact scores only where a single-precision product comes
    within that margin of the k-th best score so far.
    """
    best = (np.zeros(0, np.int64), np.zeros(0), None)
    height = scorer.rows_per_step(state)
    screening = hasattr(scorer, "margin")
    thin = state.astype(np.float32) if screening else None
    least = np.full(n_queries, -np.inf)
    for batch in slices(batches, height, min(height, _FIRST_ROWS) if screening else None):
        n = batch.num_rows
        if n == 0 or n_queries == 0:
            continue
        column = batch.column(id_column)
        ids = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(
            zero_copy_only=False
        )
        by_id = np.argsort(ids, kind="stable")
        ids, rows = ids[by_id], scorer.load(state, batch)[by_id]
        if screening and best[2] is not None:
            cells = _screened_cells(scorer, state, thin, rows, least, k)
        else:
            step = max(1, _CELLS_PER_STEP // n)
            cells = (
                _exact_cells(scorer, state, rows, lo, min(lo + step, n_queries), k)
                for lo in range(0, n_queries, step)
            )
        found = [(r, scores, ids[c]) for r, c, scores in cells if len(r)]
        if not found:
            continue
        parts = found if best[2] is None else [best, *found]
        best = keep_best(*(np.concatenate(x) for x in zip(*parts)), k)
        if screening:
            last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))
            full = last[np.diff(np.append(-1, last)) == k]
            least[best[0][full]] = best[1][full]
    return best


def result_batch(query_ids, best, schema: pa.Schema) -> pa.Table:
    rows, scores, ids = best
    if ids is None:
        return schema.empty_table()
    return pa.table(
        [query_ids.take(pa.array(rows)), pa.array(ids, schema.field(1).type), pa.array(scores)],
        schema=schema,
    )
