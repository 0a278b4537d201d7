"""Exact cosine nearest neighbours between a table of queries and a table of items.

No pair is ever emitted: tasks multiply blocks of vectors and keep the best k per query.  Two
plans give the same rows.

*Few queries* (checked: rows and bytes): the query matrix is broadcast, items stay where they are
scanned and stream through ``mapInArrow``; one shuffle of at most k rows per query and task.

*Many queries*: both sides are cut into blocks of bounded size by a hash of id and vector, each
item block meets each query block in one cell of a grid, and the cells' best rows are merged.
Neighbouring cells go to one task, up to a bound, so a row is sent to few tasks and few rows are merged.
Nothing whole passes through the driver or one task, and copies of one vector do not pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.session import wide_tasks

QUERY_ROWS = 20_000           # broadcast at most this many queries ...
QUERY_BYTES = 64 << 20        # ... and at most this many bytes of vectors
SPREAD_QUERIES = 1_000        # from here on items are spread over the cores before multiplying
CELL_QUERIES = 8_192          # grid cell: queries by items
CELL_ITEMS = 65_536
TASK_QUERIES = 65_536         # neighbouring cells one task takes: queries by items
TASK_ITEMS = 131_072
TILE_ITEMS = 4_096            # items a task scales and multiplies at once
SAMPLE = 2_048                # queries and items that settle in which directions most of their length lies
REMAINDER = 0.03              # share of the squared length that may lie in others
STRIP_ITEMS = 512             # items multiplied at once where few candidates are left
GATHER = 1_024                # pairs of rows gathered at once
DIGITS = 6                    # vectors are float32: further digits are noise, ties go to the id

_RESULT = pa.schema([("query_id", pa.int64()), ("cd_insumo", pa.int64()), ("similarity", pa.float64())])
_RESULT_DDL = "query_id bigint, cd_insumo bigint, similarity double"


def _unit_rows(column, dim: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.empty((0, dim or 0))
    if column.null_count:
        raise ValueError("nearest neighbours need a vector in every row; some rows have none")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    expected = dim if dim is not None else int(lengths[0])
    if (lengths != expected).any():
        raise ValueError(f"vectors must have {expected} numbers; some have {set(lengths.tolist()) - {expected}}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, expected)
    if not np.isfinite(rows).all():
        raise ValueError("vectors must hold finite numbers; some hold NaN, infinity or null")
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _places(hit: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mostly false matrix, looked at eight places at a time."""
    flat = hit.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``, a bounded number gathered at once."""
    out = np.empty(len(i), a.dtype)
    for low in range(0, len(i), GATHER):
        some = slice(low, low + GATHER)
        out[some] = np.einsum("ij,ij->i", a[i[some]], b[j[some]])
    return out


def _directions(sample: np.ndarray) -> np.ndarray | None:
    """The leading directions that hold most of the length of unit rows; none where it takes half of all."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    left = 1 - np.cumsum(values[::-1]) / max(values.sum(), 1e-9)
    count = 16 * (1 + int((left > REMAINDER).sum()) // 16) - 2
    return vectors[:, ::-1][:, :count] if count <= sample.shape[1] // 2 else None


def _shortened(rows: np.ndarray, directions: np.ndarray, last: float) -> np.ndarray:
    """Rows in the given directions, the length of what is left, and a column of ``last``.

    The product of two such rows, without the last column, is no less than that of the rows themselves.
    """
    lead = rows @ directions
    rest = np.sqrt(np.maximum(0, (rows ** 2).sum(1) - (lead ** 2).sum(1)) + 1e-12)
    return np.column_stack([lead, rest, np.full(len(rows), last)]).astype(np.float32)


class _Best:
    """Running best k of one block of queries, ordered by (similarity desc, id asc).

    With ``directions`` most items are ruled out by a product in these alone: what is left of two vectors
    beyond them adds no more than the product of its lengths.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, directions: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.coarse = queries.astype(np.float32)
        # single precision finds the candidates: its error on unit vectors is below this margin,
        # which also covers two rounding steps; the candidates are then computed in double
        self.margin = queries.shape[1] * 1.2e-7 + 2 * 10.0 ** -DIGITS
        self.short = None if directions is None else _shortened(queries, directions, 0.0)
        self.q = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.sim = np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # found since these were put in order
        self.waiting = 0
        # similarity and id of the k-th item so far: what a new item has to beat
        self.floor = np.full(len(queries), -np.inf)
        self.last_id = np.full(len(queries), np.iinfo(np.int64).max)

    def _ruled_in(self, rows: slice | np.ndarray, cut: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Positions of queries and items whose shortened rows reach ``cut``; none where too many do."""
        self.short[rows, -1] = -cut
        own = self.short[rows]
        product, hit = np.empty((len(own), STRIP_ITEMS), np.float32), np.empty((len(own), STRIP_ITEMS), bool)
        found, count = [], 0
        for low in range(0, len(short), STRIP_ITEMS):  # a strip's product stays in the cache
            strip = short[low:low + STRIP_ITEMS]
            if len(strip) < STRIP_ITEMS:
                product, hit = product.ravel()[:len(own) * len(strip)].reshape(len(own), -1), hit.ravel()[:len(own) * len(strip)].reshape(len(own), -1)
            np.matmul(own, strip.T, out=product)
            qi, xi = np.divmod(_places(np.greater_equal(product, np.float32(0), out=hit)), len(strip))
            found.append((qi, xi + low))
            count += len(qi)
            if count * 32 > len(own) * len(short):
                return None
        return np.concatenate([qi for qi, _ in found]), np.concatenate([xi for _, xi in found])

    def _candidates(self, coarse: np.ndarray, rows: slice | np.ndarray, short: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries and items that may reach the k-th item so far."""
        cut = self.floor[rows]
        if self.short is not None and short is not None and not np.isinf(cut).any():
            least = (cut - self.margin).astype(np.float32)
            found = self._ruled_in(rows, least, short)
            if found is not None:
                qi, xi = found
                near = _dots(self.coarse, qi if isinstance(rows, slice) else rows[qi], coarse, xi) >= least[qi]
                return qi[near], xi[near]
        sims = self.coarse[rows] @ coarse.T
        if len(coarse) > self.k and np.isinf(cut).any():
            cut = np.maximum(cut, np.partition(sims, -self.k, axis=1)[:, -self.k])
        # over the flat matrix: finding few places in two dimensions costs more than the product
        return np.divmod(_places(sims >= (cut - self.margin).astype(np.float32)[:, None]), len(coarse))

    def add(self, ids: np.ndarray, items: np.ndarray, coarse: np.ndarray, only: np.ndarray | None = None,
            short: np.ndarray | None = None) -> None:
        """Offer items to all queries of the block, or only to those at the given positions."""
        rows = slice(None) if only is None else only
        queries = self.queries[rows]
        qi, xi = self._candidates(coarse, rows, short)
        if not len(qi):
            return
        if len(qi) * 32 > len(queries) * len(ids):  # many equal items: one product is cheaper than gathering rows
            exact = (queries @ items.T)[qi, xi]
        else:
            exact = _dots(queries, qi, items, xi)
        exact = np.round(exact, DIGITS) + 0.0
        qi = qi if only is None else only[qi]
        better = (exact > self.floor[qi]) | ((exact == self.floor[qi]) & (ids[xi] < self.last_id[qi]))
        self.new.append((qi[better], ids[xi[better]], exact[better]))
        self.waiting += int(better.sum())
        # sorting costs more than a few candidates in vain
        if self.waiting * 4 >= len(self.queries) * self.k or np.isinf(self.floor).any():
            self._sort()

    def _sort(self) -> None:
        """Put the best in order again, of the queries that items were added to."""
        if not self.waiting:
            return
        changed = np.zeros(len(self.queries), bool)
        for qi, _, _ in self.new:
            changed[qi] = True
        again = changed[self.q]
        q, found, sim = (np.concatenate([old[again], *new]) for old, new in zip((self.q, self.ids, self.sim), zip(*self.new, strict=True), strict=True))
        order = np.lexsort((found, -sim, q))
        q, found, sim = q[order], found[order], sim[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.k
        q, found, sim, place = q[keep], found[keep], sim[keep], place[keep]
        self.q, self.ids, self.sim = (np.concatenate([old[~again], new]) for old, new in ((self.q, q), (self.ids, found), (self.sim, sim)))
        self.new, self.waiting = [], 0
        last = place == self.k - 1
        self.floor[q[last]] = sim[last]
        self.last_id[q[last]] = found[last]

    def table(self) -> pa.Table:
        self._sort()
        return pa.Table.from_arrays(
            [pa.array(self.query_ids[self.q]), pa.array(self.ids), pa.array(self.sim)], schema=_RESULT)


def _best_of(query_ids: np.ndarray, queries: np.ndarray, k: int, items, rows: int = 1024, cols: int = TILE_ITEMS):
    """Tables with the best k per query over an iterator of ``(ids, vectors)`` blocks of items."""
    blocks, directions = [], None
    for ids, vectors in items:
        if not blocks:
            some = max(1, len(queries) // SAMPLE), max(1, len(vectors) // SAMPLE)
            directions = _directions(np.vstack([queries[::some[0]], vectors[::some[1]]]))
            blocks = [_Best(query_ids[r:r + rows], queries[r:r + rows], k, directions) for r in range(0, len(queries), rows)]
        for c in range(0, len(ids), cols):
            part = vectors[c:c + cols]
            coarse = part.astype(np.float32)
            short = None if directions is None else _shortened(part, directions, 1.0)
            for block in blocks:
                block.add(ids[c:c + cols], part, coarse, None, short)
    for block in blocks:
        yield block.table()


def _select(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    def floats(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).cast("bigint"), F.col("vector").cast("array<float>").alias("vector"))

    return floats(queries, "query_id"), floats(items, "cd_insumo")


def _scan(queries: pa.Table, items: DataFrame, k: int) -> DataFrame:
    """Stream the items past a broadcast query matrix."""
    spark = items.sparkSession
    if not queries.num_rows:
        return spark.createDataFrame([], _RESULT_DDL)
    matrix = _unit_rows(queries.column("vector"))
    shared = spark.sparkContext.broadcast(
        (queries.column("query_id").to_numpy(), matrix))

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows = shared.value
        items = ((b.column(0).to_numpy(zero_copy_only=False), _unit_rows(b.column(1), rows.shape[1])) for b in batches)
        for table in _best_of(query_ids, rows, k, items):
            yield from table.to_batches()

    tasks = wide_tasks(spark)
    if len(matrix) >= SPREAD_QUERIES:
        # an item now costs far more to multiply than to move: spread items evenly over all cores
        placed = items.repartition(tasks, F.xxhash64("cd_insumo", "vector"))
    else:
        # items stay put; fewer, longer tasks, since each one emits up to k rows per query
        placed = items.coalesce(tasks)
    return placed.mapInArrow(local_best, _RESULT_DDL)


def _blocks(queries: int, items: int, cell_queries: int, cell_items: int, tasks: int) -> tuple[int, int]:
    """Into how many blocks queries and items are cut, so that a pair of blocks is the work of one task.

    Every row is sent to as many tasks as the other side has blocks, so blocks hold many cells: as few as
    ``TASK_QUERIES`` and ``TASK_ITEMS`` allow, or as ``tasks`` need work, and never more than there are cells.
    """
    most = 1 + queries // cell_queries, 1 + items // cell_items
    chosen = [min(most[0], 1 + queries // TASK_QUERIES), min(most[1], 1 + items // TASK_ITEMS)]
    while chosen[0] * chosen[1] < min(tasks, most[0] * most[1]):
        open_ = [side for side in (0, 1) if chosen[side] < most[side]]
        side = max(open_, key=lambda at: (queries, items)[at] / chosen[at])
        chosen[side] = min(most[side], 2 * chosen[side])
    return chosen[0], chosen[1]


def _grid(queries: DataFrame, items: DataFrame, k: int, cell_queries: int, cell_items: int) -> DataFrame:
    """Multiply every item block with every query block in cells of bounded size."""
    tasks = wide_tasks(items.sparkSession)
    query_blocks, item_blocks = _blocks(queries.count(), items.count(), cell_queries, cell_items, tasks)
    # blocks are few and costly: a number of tasks that is given stays, and pairs of blocks seldom share one
    tasks = max(tasks, min(4_096, 2 * query_blocks * item_blocks))

    def block(key: str, count: int):
        return F.pmod(F.xxhash64(key, "vector"), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("qb", block("query_id", query_blocks)).withColumn("ib", every(item_blocks))
    right = items.withColumn("ib", block("cd_insumo", item_blocks)).withColumn("qb", every(query_blocks))

    def cell(some_queries: pa.Table, some_items: pa.Table) -> pa.Table:
        if not some_queries.num_rows or not some_items.num_rows:
            return _RESULT.empty_table()
        rows = _unit_rows(some_queries.column("vector"))
        tiles = (some_items.slice(low, TILE_ITEMS) for low in range(0, some_items.num_rows, TILE_ITEMS))
        scaled = ((t.column("cd_insumo").to_numpy(), _unit_rows(t.column("vector"), rows.shape[1])) for t in tiles)
        return pa.concat_tables(_best_of(some_queries.column("query_id").to_numpy(), rows, k, scaled))

    at = ["qb", "ib"]
    return (
        left.repartition(tasks, *at).groupBy(at).cogroup(right.repartition(tasks, *at).groupBy(at))
        .applyInArrow(cell, _RESULT_DDL)
    )


def _merge(local: DataFrame, k: int, clip: bool = True) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("cd_insumo"))
    best = local.withColumn("knn_rank", F.row_number().over(order)).where(F.col("knn_rank") <= k)
    if not clip:
        return best
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("score_sbert")
    return best.select("query_id", "cd_insumo", score, "knn_rank")


def knn_grid(
    queries: DataFrame, items: DataFrame, k: int,
    cell_queries: int = CELL_QUERIES, cell_items: int = CELL_ITEMS,
) -> DataFrame:
    """Exact top-k by the grid plan, whatever the size of the query table."""
    return _merge(_grid(*_select(queries, items), k, cell_queries, cell_items), k)


def knn_exact(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` items closest to each query by cosine, all of them exact.

    ``queries`` need ``query_id, vector``; ``items`` need ``cd_insumo, vector``.  Similarities are
    rounded to six digits and equal ones ordered by id; ``score_sbert`` is clipped to [0, 1].
    With fewer than ``k`` items all of them are returned.
    """
    wanted, stored = _select(queries, items)
    if small_enough(wanted):
        return _merge(_scan(wanted.toArrow(), stored, k), k)
    return knn_grid(queries, items, k)


def small_enough(queries: DataFrame) -> bool:
    """Whether query vectors may be collected and broadcast, found without collecting any.

    Rows are counted on the ids alone, so an encoder behind the vectors does not run; then one row
    tells the length of a vector and so the bytes of all.
    """
    count = queries.select("query_id").count()
    if count > QUERY_ROWS:
        return False
    first = queries.select(F.size("vector").alias("dim")).first()
    return first is None or count * (8 + 4 * max(0, first.dim or 0)) <= QUERY_BYTES
