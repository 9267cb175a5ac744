"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagedex.operators.ranking import require_positive, top_k
from passagedex.session import cut_lineage



class Sizes(NamedTuple):
    """Bytes of vectors a task may hold."""

    # Query vectors up to this size are sent to every worker; larger sets of
    # them meet the vectors cell by cell, blocks of queries against slices.
    broadcast: int = 64 * 1024 * 1024
    block: int = 8 * 1024 * 1024
    slice: int = 64 * 1024 * 1024


SIZES = Sizes()

# Vectors that cells are formed around.
MOST_PIVOTS = 1024

# Relative allowance for what products and roots round away.
MARGIN = 1e-9

# Query rows handled by one matrix product.
QUERY_CHUNK = 256

# Queries that must meet no more slices than this are sent to them.
FEW_SLICES = 4

# Bytes of vectors in a row of a stream, and of the queries that a task holds meanwhile.
PACK = 256 * 1024
HELD = 16 * 1024 * 1024

# Tasks a core that a stream is cut into.
TASKS_PER_CORE = 3


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or not (lengths == dimension).all():
        raise ValueError(f"every vector must have {dimension} values")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dimension).astype("float64")


class _Nearest:
    """Running k best keys per query over a sequence of vector batches."""

    def __init__(self, queries: np.ndarray, k: int, limits: np.ndarray | None = None):
        self.queries = queries
        self.norms = (queries**2).sum(axis=1)
        self.k = k
        self.kept = [
            (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object))
            for _ in range(0, len(queries), QUERY_CHUNK)
        ]
        self.worst = np.full(len(queries), np.inf) if limits is None else limits.copy()

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        norms = (vectors**2).sum(axis=1)
        for chunk, start in enumerate(range(0, len(self.queries), QUERY_CHUNK)):
            part = slice(start, start + QUERY_CHUNK)
            queries, q_norms = self.queries[part], self.norms[part]
            rough = queries @ vectors.T
            rough *= -2.0
            rough += q_norms[:, None]
            rough += norms[None, :]
            # The product form rounds; keep a margin and settle on exact gaps.
            margin = MARGIN * (1.0 + q_norms + norms.max(initial=0.0))
            near = rough <= (self.worst[part] + margin)[:, None]
            if len(keys) > self.k and np.count_nonzero(near) > self.k * len(queries):
                limit = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
                near &= rough <= (limit + margin)[:, None]
            row, col = np.divmod(np.flatnonzero(near), len(keys))
            if not len(row):
                continue
            exact = ((queries[row] - vectors[col]) ** 2).sum(axis=1)
            # Only queries that found something are ranked anew.
            kept = self.kept[chunk]
            found = np.zeros(len(queries), dtype=bool)
            found[row] = True
            again = found[kept[0]]
            row = np.concatenate([kept[0][again], row])
            distance = np.concatenate([kept[1][again], exact])
            key = np.concatenate([kept[2][again], keys[col]])
            order = np.lexsort((key, distance, row))
            row, distance, key = row[order], distance[order], key[order]
            first = np.searchsorted(row, row, side="left")
            place = np.arange(len(row)) - first
            best = place < self.k
            last = row[place == self.k - 1]
            self.worst[start + last] = distance[place == self.k - 1]
            ranked = (row[best], distance[best], key[best])
            self.kept[chunk] = tuple(
                np.concatenate([old[~again], new]) for old, new in zip(kept, ranked, strict=True)
            )

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shifted = [
            (row + chunk * QUERY_CHUNK, distance, key)
            for chunk, (row, distance, key) in enumerate(self.kept)
        ]
        if not shifted:
            return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)
        return tuple(np.concatenate(column) for column in zip(*shifted))


def _result(ids: pa.Array, found: _Nearest, key_type: pa.DataType) -> pa.RecordBatch:
    row, distance, key = found.rows()
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(key, type=key_type), pa.array(distance)],
        names=["query_id", "doc_key", "distance"],
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, sizes: Sizes = SIZES
) -> DataFrame:
    """(query_id, rank, distance, doc_key): min(k, N) nearest vectors per query.

    `vectors` has (doc_key, embedding), `queries` (query_id, embedding). Each
    task keeps k rows per query while it reads, so only those are shuffled.
    """
    require_positive(k)
    size = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("embedding")).alias("dim"),
    ).first()
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_key", vectors.schema["doc_key"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    if not size["n"]:
        local = queries.sparkSession.createDataFrame([], schema)
    elif size["n"] * size["dim"] * 4 <= sizes.broadcast:
        local = _against_all(vectors, queries, k, size["dim"], schema)
    else:
        local = Cells(vectors, size["dim"], sizes).nearest(queries, k, schema)
    ranked = top_k(local, k, F.asc("distance"))
    return ranked.select("query_id", "rank", "distance", "doc_key")


def _against_all(vectors, queries, k, dimension, schema) -> DataFrame:
    """Few queries: one pass over the vectors where they lie, no shuffle of them."""
    table = queries.select("query_id", "embedding").toArrow()
    shipped = queries.sparkSession.sparkContext.broadcast(
        (table["query_id"].combine_chunks(), _matrix(table["embedding"], dimension))
    )

    def scan(batches):
        ids, matrix = shipped.value
        found = _Nearest(matrix, k)
        key_type = pa.string()
        for batch in batches:
            if batch.num_rows:
                key_type = batch.column(0).type
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                found.add(keys, _matrix(batch.column(1), dimension))
        if sum(len(kept[0]) for kept in found.kept):
            yield _result(ids, found, key_type)

    return vectors.select("doc_key", "embedding").mapInArrow(scan, schema)


def _squares(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every pivot, as products give them."""
    norms = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :]
    return np.maximum(norms - 2.0 * (points @ pivots.T), 0.0)


def _even_parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        ends = np.linspace(0, batch.num_rows, math.ceil(batch.num_rows / most) + 1).astype(int)
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield batch.slice(start, end - start)


def _kind(df: DataFrame) -> str:
    """What the values of its vectors are kept as in bytes."""
    return "f4" if df.schema["embedding"].dataType.elementType == T.FloatType() else "f8"


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)


def _numbers(part: str, count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"))).alias(part)


class Cells:
    """Vectors in cells around pivots, so that queries meet near cells only.

    Every vector lies in the cell of its nearest pivot, and a cell knows how far
    its vectors reach. A query first meets one slice of its own cell, which puts
    a ceiling on its k-th distance. By the triangle inequality no vector of a
    cell is nearer than the pivot's distance less the cell's reach; cells beyond
    the ceiling are skipped, the others are searched in full. Nothing is
    estimated, whatever the pivots.

    A cell is cut into slices by a hash of the key, and the queries sent to it
    into blocks, so a cell with a third of all vectors or queries is many tasks.
    Only queries with few slices to meet are sent to them. The others, which would
    be copied as often as there are slices, stay in tasks that read the vectors
    one pack after another, so what is shuffled grows with queries and vectors
    and not with their product. Only the pivots and one row a cell pass the driver.
    """

    def __init__(self, vectors: DataFrame, dimension: int, sizes: Sizes):
        self.vectors = vectors
        self.dimension = dimension
        self.sizes = sizes
        self.spark = vectors.sparkSession
        per_slice = max(1, sizes.slice // (dimension * 4))
        n_pivots = min(MOST_PIVOTS, math.ceil(vectors.count() / per_slice))
        # Any vectors serve as pivots; a hash of the key takes the same ones again.
        chosen = vectors.orderBy(F.xxhash64("doc_key"), "doc_key").limit(n_pivots)
        self.pivots = _matrix(chosen.select("embedding").toArrow()["embedding"], dimension)
        self.placed = cut_lineage(self._placed())
        found = (
            self.placed.groupBy("cell")
            .agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach"))
            .collect()
        )
        self.cells = np.array(sorted(r["cell"] for r in found), dtype=np.int64)
        by_cell = {r["cell"]: r for r in found}
        self.reach = np.array([by_cell[c]["reach"] for c in self.cells])
        self.slices = np.array(
            [math.ceil(by_cell[c]["n"] / per_slice) for c in self.cells], dtype=np.int64
        )

    def _placed(self) -> DataFrame:
        """(doc_key, embedding, cell, gap): gap is the distance to the cell's pivot."""
        pivots, dimension = self.pivots, self.dimension
        schema = T.StructType(
            [
                T.StructField("doc_key", self.vectors.schema["doc_key"].dataType),
                T.StructField("embedding", self.vectors.schema["embedding"].dataType),
                T.StructField("cell", T.LongType()),
                T.StructField("gap", T.DoubleType()),
            ]
        )

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _matrix(batch.column(1), dimension)
                cell = _squares(points, pivots).argmin(axis=1)
                gap = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(gap)],
                    names=["doc_key", "embedding", "cell", "gap"],
                )

        return self.vectors.select("doc_key", "embedding").mapInArrow(place, schema)

    def _near_cells(self):
        """A function of (query_id, embedding, ceiling) rows: ceilings, squared distances to
        the pivots, and which cells may hold something below the ceiling."""
        pivots, reach, dimension = self.pivots[self.cells], self.reach, self.dimension
        scale = 1.0 + (pivots**2).sum(axis=1) + reach**2

        def near_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            points = _matrix(batch.column(1), dimension)
            gaps = _squares(points, pivots)
            ceiling = batch.column(2).to_numpy(zero_copy_only=False).astype("float64")
            slack = MARGIN * (scale[None, :] + (points**2).sum(axis=1)[:, None])
            least = np.sqrt(np.maximum(gaps - slack, 0.0)) - np.sqrt(reach**2 + slack)
            near = np.maximum(least, 0.0) ** 2 <= ceiling[:, None] + slack
            near[np.isnan(ceiling)] = False
            return ceiling, gaps, near

        return near_cells

    def _sent(self, queries: DataFrame) -> DataFrame:
        """A row per query and slice it must meet; `ceiling` null: one slice of its own cell."""
        cells, slices, near_cells = self.cells, self.slices, self._near_cells()
        columns = ["query_id", "embedding", "ceiling"]
        schema = T.StructType(
            [
                *[queries.schema[c] for c in columns],
                T.StructField("cell", T.LongType()),
                T.StructField("slice", T.LongType()),
            ]
        )

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches if len(cells) else ():
                # A query may go to every slice: rows are made from few at a time.
                for at in range(0, whole.num_rows, QUERY_CHUNK):
                    batch = whole.slice(at, QUERY_CHUNK)
                    ceiling, gaps, near = near_cells(batch)
                    row, place = np.nonzero(near)
                    repeat = slices[place]
                    piece = np.arange(repeat.sum()) - np.repeat(repeat.cumsum() - repeat, repeat)
                    row, place = np.repeat(row, repeat), np.repeat(place, repeat)
                    first = np.flatnonzero(np.isnan(ceiling))
                    own = gaps[first].argmin(axis=1)
                    row = np.concatenate([row, first])
                    place = np.concatenate([place, own])
                    piece = np.concatenate([piece, first % slices[own]])
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cells[place]), pa.array(piece)],
                        names=schema.names,
                    )

        return queries.select(*columns).mapInArrow(send, schema)

    def _meet(self, sent: DataFrame, k: int, schema: T.StructType) -> DataFrame:
        """The k nearest of every slice for the queries sent there."""
        per_block = max(1, self.sizes.block // (self.dimension * 4))
        asked = (
            sent.groupBy("cell", "slice").count().groupBy("cell").agg(F.max("count").alias("n"))
        )
        known = self.spark.createDataFrame(
            list(zip(self.cells.tolist(), self.slices.tolist(), strict=True)),
            "cell bigint, n_slices bigint",
        )
        # One row a cell, a thousand at most.
        sizes = F.broadcast(
            asked.join(F.broadcast(known), "cell").select(
                "cell", "n_slices", F.ceil(F.col("n") / per_block).alias("n_blocks")
            )
        )
        left = sent.join(sizes, "cell").withColumn(
            "block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks"))
        )
        right = self.placed.join(sizes, "cell").select(
            "doc_key",
            "embedding",
            "cell",
            F.pmod(F.xxhash64("doc_key"), F.col("n_slices")).alias("slice"),
            _numbers("block", F.col("n_blocks")),
        )
        dimension = self.dimension

        def meet(query_table: pa.Table, vector_table: pa.Table) -> pa.Table:
            ids = query_table["query_id"].combine_chunks()
            limits = query_table["ceiling"].combine_chunks().to_numpy(zero_copy_only=False)
            limits = np.nan_to_num(limits.astype("float64"), nan=np.inf, posinf=np.inf)
            found = _Nearest(_matrix(query_table["embedding"], dimension), k, limits)
            key_type = vector_table["doc_key"].type
            for batch in vector_table.to_batches(max_chunksize=10_000):
                keys = np.array(batch.column("doc_key").to_pylist(), dtype=object)
                found.add(keys, _matrix(batch.column("embedding"), dimension))
            return pa.Table.from_batches([_result(ids, found, key_type)])

        group = ["cell", "slice", "block"]
        left = left.select("query_id", "embedding", "ceiling", *group)
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, schema)

    def _faced(self, queries: DataFrame) -> DataFrame:
        """The queries with their own cell and the number of slices they must meet."""
        cells, slices, near_cells = self.cells, self.slices, self._near_cells()
        columns = ["query_id", "embedding", "ceiling"]
        schema = T.StructType(
            [
                *[queries.schema[c] for c in columns],
                T.StructField("cell", T.LongType()),
                T.StructField("n_slices", T.LongType()),
            ]
        )

        def face(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _even_parts(batches if len(cells) else (), QUERY_CHUNK):
                _, gaps, near = near_cells(batch)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells[gaps.argmin(axis=1)]), pa.array(near @ slices)],
                    names=schema.names,
                )

        return queries.select(*columns).mapInArrow(face, schema)

    def _packed(self, rows: DataFrame, columns: list[T.StructField], most: int, pack) -> DataFrame:
        """Up to so many rows of neighbouring cells in one; `pack` makes the columns of them."""
        schema = T.StructType([*columns, T.StructField("vectors", T.BinaryType())])
        dimension, kind = self.dimension, _kind(rows)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _even_parts(batches, most):
                vectors = _matrix(part.column("embedding"), dimension).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*pack(part), pa.array([vectors], type=pa.binary())], names=schema.names
                )

        # By the first column too: a cell may hold any share of the rows.
        together = rows.repartitionByRange("cell", F.xxhash64(rows.columns[0]))
        packs = together.sortWithinPartitions("cell").mapInArrow(make, schema)
        return packs.withColumn("pack", F.monotonically_increasing_id())

    def _packed_vectors(self) -> DataFrame:
        """(keys, cells, vectors, pack)"""
        columns = [
            T.StructField("keys", T.ArrayType(self.placed.schema["doc_key"].dataType)),
            T.StructField("cells", T.ArrayType(T.LongType())),
        ]

        def pack(part: pa.RecordBatch) -> list[pa.Array]:
            return [_one_list(part.column("doc_key")), _one_list(part.column("cell").unique())]

        most = max(1, min(self.sizes.slice, PACK) // (self.dimension * 4))
        rows = self.placed.select("doc_key", "embedding", "cell")
        return self._packed(rows, columns, most, pack)

    def _packed_queries(self, faced: DataFrame) -> DataFrame:
        """(ids, ceilings, near, vectors, pack): near are the cells that any of them must meet."""
        cells, near_cells = self.cells, self._near_cells()
        columns = [
            T.StructField("ids", T.ArrayType(faced.schema["query_id"].dataType)),
            T.StructField("ceilings", T.ArrayType(T.DoubleType())),
            T.StructField("near", T.ArrayType(T.LongType())),
        ]

        def pack(part: pa.RecordBatch) -> list[pa.Array]:
            near = near_cells(part)[2].any(axis=0)
            found = [part.column("query_id"), part.column("ceiling"), pa.array(cells[near])]
            return [_one_list(values) for values in found]

        return self._packed(faced, columns, self._queries_per_pack(), pack)

    def _queries_per_pack(self) -> int:
        return max(1, min(self.sizes.block, PACK) // (self.dimension * 4))

    def _streamed(self, faced: DataFrame, n: int, k: int, schema: T.StructType) -> DataFrame:
        """The k nearest of n queries: every task holds some and reads the vectors' packs once."""
        enough = TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism
        held = math.ceil(n * self.dimension * 4 / HELD)
        n_query_parts = max(held, min(enough, math.ceil(n / self._queries_per_pack())))
        # Few queries: the vectors are read in parts, and each part gives k rows a query.
        n_vector_parts = math.ceil(enough / n_query_parts)
        asked = cut_lineage(self._packed_queries(faced).repartition(n_query_parts))
        vectors = cut_lineage(self._packed_vectors().repartition(n_vector_parts))
        asked = asked.withColumnsRenamed({"vectors": "asked", "pack": "query_pack"})
        vectors = vectors.withColumnRenamed("pack", "vector_pack")
        # A task keeps the right side's part and reads the left side's row by row.
        kept = asked.hint("shuffle_replicate_nl")
        pairs = vectors.join(kept, F.arrays_overlap("cells", "near")).drop("cells", "near")
        dimension = self.dimension
        kind, asked_kind = _kind(self.placed), _kind(faced)

        def matrix(value: pa.Scalar, kind: str) -> np.ndarray:
            return np.frombuffer(value.as_buffer(), kind).reshape(-1, dimension).astype("float64")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[pa.Array, _Nearest]] = {}
            key_type, at = None, None
            for batch in batches:
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                key_type = column["keys"].type.value_type
                packs = (column[c].to_pylist() for c in ("vector_pack", "query_pack"))
                for row, (vector_pack, query_pack) in enumerate(zip(*packs, strict=True)):
                    if vector_pack != at:
                        at = vector_pack
                        keys = np.array(column["keys"][row].values.to_pylist(), dtype=object)
                        points = matrix(column["vectors"][row], kind)
                    if query_pack not in found:
                        limits = column["ceilings"][row].values.to_numpy(zero_copy_only=False)
                        # Taken out of the batch, which would stay in memory for them.
                        ids = column["ids"][row].values.take(pa.array(np.arange(len(limits))))
                        of_queries = matrix(column["asked"][row], asked_kind)
                        found[query_pack] = ids, _Nearest(of_queries, k, limits)
                    found[query_pack][1].add(keys, points)
            for ids, best in found.values():
                yield _result(ids, best, key_type)

        return pairs.mapInArrow(meet, schema)

    def nearest(self, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
        """At least the k nearest of every query, with others."""
        own = self._sent(queries.withColumn("ceiling", F.lit(None).cast("double")))
        rough = top_k(self._meet(own, k, schema), k, F.asc("distance"))
        ceilings = rough.where(F.col("rank") == k).select(
            "query_id", F.col("distance").alias("ceiling")
        )
        known = queries.select("query_id", "embedding").join(ceilings, "query_id", "left")
        no_limit = F.coalesce("ceiling", F.lit(float("inf"))).alias("ceiling")
        faced = cut_lineage(self._faced(known.select("query_id", "embedding", no_limit)))
        few = F.col("n_slices") <= FEW_SLICES
        n = faced.agg(F.count_if(few).alias("few"), F.count_if(~few).alias("many")).first()
        parts = []
        if n["few"] or not n["many"]:
            parts.append(self._meet(cut_lineage(self._sent(faced.where(few))), k, schema))
        if n["many"]:
            streamed = faced.where(~few).select("query_id", "embedding", "ceiling", "cell")
            parts.append(self._streamed(streamed, n["many"], k, schema))
        return reduce(DataFrame.union, parts)
