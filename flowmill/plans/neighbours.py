"""Exact nearest neighbours of every row: a join in metric space.

Base vectors fall into the cells of seeded pivots and are cut, in order of distance to their pivot, into
blocks of bounded size; a dense cell is many blocks, each a ring around its pivot. Query rows are
blocks of the same kind. A block of queries first meets one base block near it, which
bounds the distance of each row's second neighbour. By the triangle inequality that bound
excludes most other rings; what is left is visited block by block, in tiles of neighbouring blocks on both
sides, and a row takes part only where its own bound reaches the ring. Nothing is sampled but the pivots, and these decide only the work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowmill.session import cut_lineage, release, stored

# Pivots are held by every task: the root of the number of base vectors, up to this many.
MAX_PIVOTS = 512
BLOCK_BYTES = 1 << 20
# Elements of one matrix of distances.
MATRIX = 1 << 21
# Blocks on a side of a tile, at most: both sides of one are held by a task.
MAX_TILE = 32


def _usable(vector: str, width: int) -> Column:
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) == width) & F.forall(v, fine), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots, rounded as a product of matrices rounds them; used for bounds only."""
    middle = pivots.mean(0)
    a, b = rows - middle, pivots - middle
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _slack(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How far a distance of `_distances` may be off, for each row."""
    middle = pivots.mean(0)
    largest = ((pivots - middle) ** 2).sum(1).max()
    return np.sqrt(1e-14 * (rows.shape[1] + 4) * (((rows - middle) ** 2).sum(1) + largest))


def two_nearest(rows: np.ndarray, points: np.ndarray, counts: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """(rows, 2) distances to the two nearest points, where a point counts `counts` times; infinity without one.

    A product of matrices picks every point that rounding leaves in question; its differences are then taken directly.
    Points that are not nearer than a row's `limit` may be left out: where all rows have one, none are ranked for it."""
    out = np.full((len(rows), 2), np.inf)
    if not len(points) or not len(rows):
        return out
    middle = points.mean(0)
    b = points - middle
    b_size = (b * b).sum(1)
    step, k = max(1, MATRIX // len(points)), min(2, len(points)) - 1
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        a = part - middle
        a_size = (a * a).sum(1)
        near = a_size[:, None] + b_size - 2 * a @ b.T
        if limit is not None and np.isfinite(limit[at:at + step]).all():
            bound = limit[at:at + step] ** 2
        else:
            bound = np.partition(near, k, axis=1)[:, k]
        bound = bound + 1e-14 * (rows.shape[1] + 4) * (a_size + b_size.max())
        row, point = np.nonzero(near <= bound[:, None])
        if not len(row):
            continue
        exact = np.concatenate([((part[row[i:i + MATRIX]] - points[point[i:i + MATRIX]]) ** 2).sum(1)
                                for i in range(0, len(row), MATRIX)])
        order = np.lexsort((exact, row))
        row, point, exact = row[order], point[order], np.sqrt(exact[order])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        second = np.minimum(first + 1, len(row) - 1)
        twice = counts[point[first]] > 1
        after = np.where((second > first) & (row[second] == row[first]), exact[second], np.inf)
        out[at + row[first], 0] = exact[first]
        out[at + row[first], 1] = np.where(twice, exact[first], after)
    return out


def _in_cells(df: DataFrame, pivots: np.ndarray, carry: list[str]) -> DataFrame:
    """`cell` and `dist` of the nearest pivot beside v and `carry`, in order of both within range partitions."""
    width = pivots.shape[1]
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()),
                           df.schema["v"], *[df.schema[c] for c in carry]])

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("v"), width)
            cell = np.concatenate([_distances(rows[i:i + 4096], pivots).argmin(1) for i in range(0, len(rows), 4096)]
                                  or [np.zeros(0, np.int64)])
            dist = np.sqrt(((rows - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(dist), batch.column("v"),
                                              *[batch.column(c) for c in carry]], names=schema.names)

    # The hash parts rows of one cell and distance.
    near = df.select("v", *carry).mapInArrow(run, schema).withColumn("_h", F.xxhash64("v"))
    return near.repartitionByRange("cell", "dist", "_h").sortWithinPartitions("cell", "dist", "_h").drop("_h")


def _blocks(df: DataFrame, width: int, carry: str, block_bytes: int) -> DataFrame:
    """Runs of rows of one cell as blocks: block, cell, near and far (distances to the pivot), vecs, and the list of `carry`."""
    most = max(1, block_bytes // (8 * width))
    item = df.schema[carry].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("near", T.DoubleType()), T.StructField("far", T.DoubleType()),
                           T.StructField("vecs", T.BinaryType()), T.StructField(carry, T.ArrayType(item))])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def block():
            nonlocal number, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            dist = rows.column("dist").to_numpy()
            vecs = _matrix(rows.column("v").combine_chunks(), width)
            values = pa.concat_arrays(rows.column(carry).chunks)
            listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), rows.column("cell").combine_chunks()[:1], pa.array([dist.min()]),
                 pa.array([dist.max()]), pa.array([vecs.tobytes()], pa.binary()), listed], names=schema.names)
            number, held, size = number + 1, [], 0
            return out

        cell_now = None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:]):
                if a < b and cells[a] != cell_now:
                    if size:
                        yield block()
                    cell_now = cells[a]
                while a < b:
                    take = min(b - a, most - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == most:
                        yield block()
        if size:
            yield block()

    return df.mapInArrow(run, schema)


def _unpack(vecs: bytes, width: int) -> np.ndarray:
    return np.frombuffer(vecs, np.float64).reshape(-1, width)


def _bounds(best: np.ndarray, rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No row's second neighbour is farther than this, and its distances to the pivots."""
    reach = _distances(rows, pivots)
    slack = _slack(rows, pivots)
    bound = best[:, 1]
    if len(pivots) > 1:  # pivots are different base vectors
        bound = np.minimum(bound, np.partition(reach, 1, axis=1)[:, 1] + slack)
    return bound * (1 + 1e-9) + slack, reach


def rings_in_reach(rows: np.ndarray, best: np.ndarray, pivots: np.ndarray, apart: np.ndarray):
    """Cells that may hold a second neighbour of some row, and the least and greatest distance from their pivot at which."""
    middle = pivots.mean(0)
    longest = ((pivots - middle) ** 2).sum(1).max()
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for at in range(0, len(rows), 4096):
        part = rows[at:at + 4096]
        bound, reach = _bounds(best[at:at + 4096], part, pivots)
        own = reach.argmin(1)
        # A vector of another cell lies beyond the plane half-way to that cell's pivot, but for the rounding of
        # its own distances and these; no wanted vector is longer than the row and its bound together.
        size = np.sqrt(((part - middle) ** 2).sum(1)) + bound
        loose = 4e-14 * (rows.shape[1] + 4) * (size ** 2 + longest)
        beyond = reach ** 2 - reach[np.arange(len(part)), own][:, None] ** 2 - loose[:, None]
        plane = np.where(apart[own] > 0, beyond / np.maximum(2 * apart[own], 1e-300), 0)
        open_ = plane <= bound[:, None]
        low = np.minimum(low, np.where(open_, reach - bound[:, None], np.inf).min(0))
        high = np.maximum(high, np.where(open_, reach + bound[:, None], -np.inf).max(0))
    cells = np.flatnonzero(low <= high)
    return cells, low[cells], high[cells]


def tile_side(askers: int, blocks: int, tasks: int) -> int:
    """Blocks on a side of a tile: as many as leave a tile for every task. A block here is BLOCK_BYTES, however many
    blocks of rows, which end with their cell, fill it."""
    return max(1, min(MAX_TILE, math.isqrt(askers * blocks // max(tasks, 1))))


def nearest_two(query: DataFrame, base: DataFrame, vector: str = "v", key: str = "id",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, d1, d2): Euclidean distances of every query row to its two nearest base vectors, over all rows of both.

    d2 is null when the base has one row; copies of a base vector count each. Base rows whose vector is null,
    incomplete or not finite are left out, query rows of that kind and those without a base get nulls. Null and
    repeated keys keep their rows. The result is checkpointed, so that later passes do not search again.
    """
    key_type = query.schema[key].dataType
    named = query.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    points = base.select(F.col(vector).cast("array<double>").alias("v"))
    width = max(points.agg(F.max(F.size("v"))).first()[0] or 0, 0)
    nothing = lambda rows: rows.select(F.col("key").alias(key), F.lit(None).cast("double").alias("d1"),
                                       F.lit(None).cast("double").alias("d2"))
    if not width:
        return nothing(named)
    # Copies meet before anything else is done with them.
    distinct = stored(points.where(_usable("v", width)).groupBy("v").agg(F.count("*").alias("n")))
    total = distinct.count()
    if not total:
        return nothing(named)
    picked = distinct.orderBy(F.xxhash64("v"), "v").limit(min(MAX_PIVOTS, math.ceil(math.sqrt(total)))).select("v").toArrow()
    pivots = _matrix(picked.column("v").combine_chunks(), width)
    apart = np.sqrt(((pivots[:, None] - pivots) ** 2).sum(2))

    bases = cut_lineage(_blocks(_in_cells(distinct, pivots, ["n"]), width, "n", block_bytes))
    release(distinct)
    usable = _usable("v", width)
    asked = _blocks(_in_cells(named.where(usable), pivots, ["key"]), width, "key", block_bytes)
    asked = cut_lineage(asked.withColumnsRenamed({"block": "asker", "near": "from", "far": "to"}))

    rings = bases.select("block", "cell", "near", "far")
    gap = F.abs(F.col("near") + F.col("far") - F.col("from") - F.col("to"))
    start = asked.select("asker", "cell", "from", "to").join(rings, "cell").groupBy("asker").agg(
        F.min_by("block", F.struct(gap, "block")).alias("block"))
    held = bases.select("block", "near", "far", F.col("vecs").alias("base"), "n")
    met = start.join(held, "block").join(asked.drop("from", "to"), "asker").select(
        "asker", "cell", "key", "vecs", "block", "base", "n")
    best_schema = T.StructType([met.schema[c] for c in ("asker", "cell", "key", "vecs", "block")]
                               + [T.StructField("best", T.BinaryType())])

    def meet(batches):
        for batch in batches:
            found = [two_nearest(_unpack(q.as_py(), width), _unpack(b.as_py(), width), np.array(n.as_py())).tobytes()
                     for q, b, n in zip(batch.column("vecs"), batch.column("base"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in best_schema.names[:-1]], pa.array(found, pa.binary())],
                                             names=best_schema.names)

    first = cut_lineage(met.mapInArrow(meet, best_schema))

    def reachable(batches):
        for batch in batches:
            for asker, vecs, best in zip(batch.column("asker").to_pylist(), batch.column("vecs"), batch.column("best")):
                cells, low, high = rings_in_reach(
                    _unpack(vecs.as_py(), width), np.frombuffer(best.as_py(), np.float64).reshape(-1, 2), pivots, apart)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), asker)), pa.array(cells.astype(np.int32)), pa.array(low), pa.array(high)],
                    names=["asker", "cell", "low", "high"])

    wanted = first.select("asker", "vecs", "best").mapInArrow(reachable, "asker long, cell int, low double, high double")
    visits = wanted.join(rings, "cell").where("far >= low AND near <= high").select("asker", "block", "cell").join(
        first.select("asker", "block"), ["asker", "block"], "left_anti")
    # Visits are dealt as tiles, a group of askers by a group of blocks: a block moves once per group it meets, not
    # once per block. Groups are of bytes, so that few rows are one group whatever cells they lie in, and the large
    # side moves once.
    filled = lambda blocks: math.ceil((blocks.agg(F.sum(F.length("vecs"))).first()[0] or 0) / block_bytes)
    size = tile_side(filled(first), filled(bases), int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One line per block: these windows order numbers only.
    grouped = lambda blocks, name, group: blocks.select(name, F.length("vecs").alias("bytes")).select(
        name, F.floor((F.sum("bytes").over(Window.orderBy(name)) - 1) / (size * block_bytes)).alias(group))
    tiles = cut_lineage(visits.select("asker", "block").join(grouped(first, "asker", "ga"), "asker").join(
        grouped(bases, "block", "gb"), "block"))
    askers = tiles.groupBy("ga", "gb", "asker").agg(F.collect_list("block").alias("blocks")).join(
        first.select("asker", "vecs", "best"), "asker")
    visited = tiles.select(F.col("ga").alias("ha"), F.col("gb").alias("hb"), "block").distinct().join(
        bases.select("block", "cell", "near", "far", F.col("vecs").alias("base"), "n"), "block")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        # Rows of all askers lie one after the other and meet a block together.
        vecs = [_unpack(v.as_py(), width) for v in left.column("vecs")]
        ends = np.cumsum([len(v) for v in vecs])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        if len(vecs) and right.num_rows:
            rows = np.concatenate(vecs)
            best = np.concatenate([np.frombuffer(b.as_py(), np.float64).reshape(-1, 2) for b in left.column("best")])
            owner = np.repeat(left.column("asker").to_numpy(), [len(v) for v in vecs])
            place = np.concatenate([np.arange(len(v), dtype=np.int32) for v in vecs])
            wanted_by = {}
            for i, blocks in enumerate(left.column("blocks").to_pylist()):
                for block in blocks:
                    wanted_by.setdefault(block, []).append(i)
            cells, nears, fars = (right.column(c).to_numpy() for c in ("cell", "near", "far"))
            points, counts = right.column("base"), right.column("n")
            for i, block in enumerate(right.column("block").to_pylist()):
                at = np.concatenate([np.arange(ends[k] - len(vecs[k]), ends[k]) for k in wanted_by[block]])
                bound, reach = _bounds(best[at], rows[at], pivots[cells[i]:cells[i] + 1])
                reach = reach[:, 0]
                some = at[(reach - bound <= fars[i]) & (reach + bound >= nears[i])]
                two = two_nearest(rows[some], _unpack(points[i].as_py(), width), np.array(counts[i].as_py()), best[some, 1])
                row, rank = np.nonzero(two < best[some, 1:])
                found.append((owner[some[row]], place[some[row]], two[row, rank]))
                # What this tile has found narrows its further visits.
                best[some] = np.sort(np.concatenate([best[some], two], axis=1), axis=1)[:, :2]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["asker", "at", "d"])

    later = askers.groupBy("ga", "gb").cogroup(visited.groupBy("ha", "hb")).applyInArrow(
        visit, "asker long, at int, d double")

    def begun(batches):
        for batch in batches:
            for i, (asker, keys, best) in enumerate(zip(batch.column("asker"), batch.column("key"), batch.column("best"))):
                both = np.frombuffer(best.as_py(), np.float64)
                at = np.repeat(np.arange(len(both) // 2, dtype=np.int32), 2)
                values = batch.column("key").slice(i, 1).flatten().take(pa.array(at))
                fine = np.flatnonzero(np.isfinite(both))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), asker.as_py())), pa.array(at), pa.array(both), values],
                    names=["asker", "at", "d", "key"]).take(pa.array(fine))

    key_field = T.StructType([T.StructField("asker", T.LongType()), T.StructField("at", T.IntegerType()),
                              T.StructField("d", T.DoubleType()), T.StructField("key", key_type)])
    seen = first.select("asker", "key", "best").mapInArrow(begun, key_field)
    nearer = Window.partitionBy("asker", "at").orderBy("d")
    # The key comes with the first meeting, whose distances may both be beaten.
    names = seen.groupBy("asker", "at").agg(F.first("key").alias("key"))
    ranked = seen.drop("key").unionByName(later).withColumn("rank", F.row_number().over(nearer)).where("rank <= 2")
    two = ranked.groupBy("asker", "at").agg(F.min("d").alias("d1"), F.when(F.count("*") > 1, F.max("d")).alias("d2"))
    result = names.join(two, ["asker", "at"]).select(F.col("key").alias(key), "d1", "d2")
    return cut_lineage(result.unionByName(nothing(named.where(~usable))))
