"""Most similar vectors for every vector, by multi-probe p-stable hashing with exact distance reranking.

Every vector, scaled to length 1, is hashed in several tables by Gaussian projections cut into cells. The projections are
drawn within the leading principal directions of all vectors (their covariance is summed over every row): there, neighbours
differ much less than other pairs do. As a query, a vector visits the cells in the order of the probability that a neighbour lies there:
the product over the projections of the normal probability of the cell, for a neighbour as far away as the k-th best known so far. It stops
when the visited cells hold a neighbour with the wished probability, so that vectors with close neighbours visit few cells.

No vector is shuffled for a visit. Each table is written once, sorted by cell, in files of a block of vectors; a task takes a block of queries,
which lie near each other, and reads from the files what they visit. It holds one block of queries, one of members and the queries' best so far, so that neither disk nor
memory grows with the number of visits. What reaches a query's k-th best in single precision gets its similarity in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.session import Scratch

#: Vectors of a file, and so queries that a task holds and members that it reads at once.
BLOCK = 16_384
#: Neighbouring vectors of a block that are compared for the first bounds.
FIRST = 4096
#: Such a part holds only some of a vector's neighbours: the distance of its best of so many there stands for that of the k-th of all.
SHARE = 3
#: Cells that follow each other are compared together until they hold so many vectors; who visits one of them meets all.
PACK = 32
#: Places go from -REACH to REACH, the outermost without end: seven standard deviations and more from the mean at the usual width.
REACH = 4


def _normal(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to seven places (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


@dataclass(frozen=True)
class Hashing:
    """``tables`` hash tables of ``hashes`` projections; in each, cells are visited until ``success`` is reached.

    ``hashes`` 0 takes half the binary logarithm of the number of vectors, so that cells stay about as full while their number grows with
    the root of the rows; ``probes``, if not 0, leaves out cells that are less probable than one in so many, and so visits no more. ``width`` is that of a cell in
    standard deviations of the projected vectors.
    """

    tables: int = 2
    hashes: int = 0
    width: float = 1.8
    probes: int = 0
    success: float = 0.85
    seed: int = 7

    def fit(self, rows: int, mean: np.ndarray, covariance: np.ndarray) -> Tables:
        """Tables for so many rows with this mean and covariance."""
        dims = len(mean)
        k = min(dims, self.hashes or max(1, round(np.log2(max(rows, 2)) / 2)))
        value, vector = np.linalg.eigh(covariance)
        lead, spread = vector[:, ::-1][:, :k], np.sqrt(max(value[::-1][:k].mean(), 1e-12))
        rng = np.random.default_rng(self.seed)
        width = self.width * spread
        turns = [np.linalg.qr(rng.standard_normal((k, k)))[0] for _ in range(self.tables)]
        offsets = [rng.uniform(0, width, k) - mean @ (lead @ turn) for turn in turns]
        return Tables([lead @ turn for turn in turns], offsets, width, self.probes, self.success)


@dataclass(frozen=True)
class Tables:
    """Fitted projections. A cell is named by the places of its vectors, one number for each projection."""

    projections: list[np.ndarray]
    offsets: list[np.ndarray]
    width: float
    probes: int
    success: float

    def _at(self, unit: np.ndarray, t: int) -> np.ndarray:
        return (unit @ self.projections[t] + self.offsets[t]) / self.width

    def places(self, unit: np.ndarray, t: int) -> np.ndarray:
        """The cell of each vector in table ``t``."""
        return np.clip(np.floor(self._at(unit, t)), -REACH, REACH).astype(np.int8)

    def chances(self, unit: np.ndarray, radius: np.ndarray, t: int) -> Chances:
        """For each vector as a query in table ``t``, how probable cells are for neighbours at its distance ``radius``, and which of them it visits.

        The logarithm of the probability of the cell that a neighbour is in is a sum over independent places; that which it falls below only with
        the probability of failure follows from the sum's mean, variance and skewness (Cornish and Fisher).
        """
        at = self._at(unit, t)
        edges = np.array([-np.inf, *range(1 - REACH, REACH + 1), np.inf])
        spread = np.maximum(radius / np.sqrt(unit.shape[1]) / self.width, 1e-6)
        chance = np.maximum(np.diff(_normal((edges - at[:, :, None]) / spread[:, None, None]), axis=2), 1e-12)
        log = np.log(chance)
        mean = (chance * log).sum(axis=2)
        off = log - mean[:, :, None]
        variance, third = ((chance * off**n).sum(axis=2).sum(axis=1) for n in (2, 3))
        sd = np.sqrt(np.maximum(variance, 1e-12))
        z = NormalDist().inv_cdf(1 - self.success)
        least = mean.sum(axis=1) + sd * z + (z * z - 1) / 6 * third / sd**2
        if self.probes:
            least = np.maximum(least, -np.log(self.probes))
        return Chances(log.astype(np.float32), (np.minimum(least, log.max(axis=2).sum(axis=1)) - 1e-3).astype(np.float32))


@dataclass(frozen=True)
class Chances:
    """Of each query and place the logarithms of the chances of the values from -REACH on; cells whose sum reaches ``least`` are visited."""

    log: np.ndarray
    least: np.ndarray

    def within(self, cells: np.ndarray) -> np.ndarray:
        """The queries that could visit one of these cells, as far as each place tells alone."""
        best = np.zeros(len(self.least), dtype=np.float32)
        for j in range(cells.shape[1]):
            best += self.log[:, j, np.unique(cells[:, j]) + REACH].max(axis=1)
        return np.flatnonzero(best >= self.least)

    def visited(self, rows: np.ndarray, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each pack whether each of these queries visits a cell of it, packs being runs of cells from ``starts``."""
        n, values = cells.shape[1], self.log.shape[2]
        hot = np.zeros((len(cells), n * values), dtype=np.float32)
        hot[np.arange(len(cells))[:, None], cells + REACH + np.arange(n) * values] = 1
        out = np.empty((len(starts), len(rows)), dtype=bool)
        step = max(1, 8_000_000 // len(cells))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            reached = hot @ self.log[r].reshape(len(r), -1).T >= self.least[r]
            for p, (begin, end) in enumerate(zip(starts, [*starts[1:], len(cells)], strict=True)):  # reduceat takes ten times as long
                reached[begin:end].any(axis=0, out=out[p, a : a + step])
        return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, vec): one row for each key with ``dims`` finite numbers that are not all zero; of several the least."""
    v = F.col(vector).cast("array<float>")
    fine = F.col(key).isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(v).alias("vec"))


def moments(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors (vec), scaled to length 1. Only dims * (dims + 1) sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims + 1, dims))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                sums += np.vstack([x.T @ x, x.sum(axis=0)])
        yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["place", "value"])

    rows = vectors.select("vec", F.lit(1)).mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    n = max(vectors.count(), 1)
    sums = np.zeros((dims + 1) * dims)
    for r in rows.collect():
        sums[r["place"]] = r["value"]
    sums = sums.reshape(dims + 1, dims) / n
    return sums[-1], sums[:-1] - np.outer(sums[-1], sums[-1])


def _kth(sims: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if sims.shape[1] < k:
        return np.full(len(sims), -np.inf)
    return -np.partition(-sims, k - 1, axis=1)[:, k - 1]


def _best_of(rows: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row, equal similarity going to the smaller ``near``; a pair found twice counts once."""
    order = np.lexsort((near, -sims, rows))
    r, m = rows[order], near[order]
    again = np.concatenate([[False], (r[1:] == r[:-1]) & (m[1:] == m[:-1])]) if len(r) else np.zeros(0, dtype=bool)
    order, r = order[~again], r[~again]
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[rank < k]


def _part(path: str, columns: list[str]) -> pa.Table:
    """Columns of a file of the shared folder."""
    system, inner = pa.fs.FileSystem.from_uri(path)
    return pq.read_table(inner, columns=columns, filesystem=system, use_threads=False, partitioning=None)


def _cells(part: pa.Table, hashes: int) -> np.ndarray:
    """The places of each row's cell."""
    return np.frombuffer(b"".join(part.column("cell").to_pylist()), dtype=np.int8).reshape(-1, hashes)


class _Block:
    """Queries (id, vec, n) and the k best that are known of each, by descending similarity and ascending key."""

    def __init__(self, part: pa.Table, dims: int, k: int):
        self.k, self.ids = k, part.column("id").to_numpy()
        self.exact = _matrix(part.column("vec"), dims)
        self.single = self.exact.astype(np.float32)
        self.near = np.full((len(self.ids), k), -1, np.int64)
        self.many = np.zeros((len(self.ids), k), np.int64)
        self.sims = np.full((len(self.ids), k), -np.inf)
        self.floor = np.full(len(self.ids), -np.inf)
        self.guess = np.full(len(self.ids), -np.inf)
        held, edges = [], np.linspace(0, len(self.ids), -(-len(self.ids) // FIRST) + 1).astype(int)
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            for a in range(begin, end, 512):
                sims = self.single[a : min(a + 512, end)] @ self.single[begin:end].T
                q = np.arange(a, a + len(sims))
                sims[q - a, q - begin] = -np.inf
                self.floor[q], self.guess[q] = _kth(sims, k) - 1e-5, _kth(sims, -(-k // SHARE))
                i, j = np.nonzero((sims >= self.floor[q, None].astype(np.float32)) & np.isfinite(sims))
                held.append((q[i], begin + j))
        self._take(held, self.ids, self.exact, part)

    def radius(self) -> np.ndarray:
        """The distance that the k-th neighbour is taken to have: the k-th best so far, if that is nearer than the guess."""
        return np.sqrt(np.clip(2 - 2 * np.maximum(self.guess, self.sims[:, -1]), 1e-6, 2.0))

    def meet(self, chances: Chances, path: str, hashes: int) -> None:
        """Compares the queries with the members of a file in the cells that they visit."""
        part = _part(path, ["cell"])
        if not part.num_rows:
            return
        places = _cells(part, hashes)
        fresh = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]).any(axis=1)]))
        rows = chances.within(places[fresh])
        if not len(rows):
            return
        starts = np.flatnonzero(np.diff(fresh // PACK, prepend=-1))  # a cell of a full pack or more is alone, or last of its pack
        visited = chances.visited(rows, places[fresh], starts)
        if not visited.any():
            return
        part = _part(path, ["id", "vec", "n"])
        ids, exact = part.column("id").to_numpy(), _matrix(part.column("vec"), self.exact.shape[1])
        y = exact.astype(np.float32)
        held, size = [], 0
        for p in np.flatnonzero(visited.any(axis=1)):
            begin, end = fresh[starts[p]], fresh[starts[p + 1]] if p + 1 < len(starts) else len(ids)
            mine = rows[visited[p]]
            for a in range(begin, end, 1024):
                m = np.arange(a, min(a + 1024, end))
                for b in range(0, len(mine), 4096):
                    q = mine[b : b + 4096]
                    sims = self.single[q] @ y[m].T
                    least = self.floor[q]
                    if len(m) > 4 * self.k and np.isinf(least).any():  # what k others of the pack exceed cannot be among the best
                        least = np.maximum(least, _kth(sims, self.k + 1) - 1e-5)
                    i, j = np.divmod(np.flatnonzero(sims >= least[:, None].astype(np.float32)), len(m))
                    held.append((q[i], m[j]))
                    size += len(i)
            if size > 1_000_000:
                self._take(held, ids, exact, part)
                held, size = [], 0
        self._take(held, ids, exact, part)

    def _take(self, held: list[tuple], ids: np.ndarray, exact: np.ndarray, part: pa.Table) -> None:
        """Takes what belongs to the k best of the queries among these pairs of a query and a member."""
        if not held:
            return
        q, m = (np.concatenate(c) for c in zip(*held, strict=True))
        q, m = (c[self.ids[q] != ids[m]] for c in (q, m))
        if not len(q):
            return
        many = part.column("n").to_numpy()
        sim = np.concatenate([np.einsum("ij,ij->i", self.exact[q[a : a + 65536]], exact[m[a : a + 65536]]) for a in range(0, len(q), 65536)])
        touched = np.unique(q)
        old, col = np.nonzero(np.isfinite(self.sims[touched]))
        old = touched[old]
        row = np.concatenate([old, q])
        near, sims, many = (np.concatenate([mine[old, c], new]) for mine, c, new in ((self.near, col, ids[m]), (self.sims, col, sim), (self.many, col, many[m])))
        keep = _best_of(row, near, sims, self.k)
        row, near, sims, many = (c[keep] for c in (row, near, sims, many))
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        self.near[row, place], self.sims[row, place], self.many[row, place] = near, sims, many
        self.floor[touched] = np.maximum(self.floor[touched], self.sims[touched, -1] - 1e-5)

    def found(self, n: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.sims))
        columns = (self.ids[row], self.near[row, place], self.sims[row, place], (place + 1).astype(np.int32), n[row], self.many[row, place])
        plain = (n == 1) & ~(self.many > 1).any(axis=1)
        return pa.record_batch([*map(pa.array, columns), pa.array(plain[row])], names=["id", "near", "sim", "rank", "n", "near_n", "plain"])


FOUND = "id bigint, near bigint, sim double, rank int, n bigint, near_n bigint, plain boolean"


def _visited(files: list[list[str]], spark: SparkSession, tables: Tables, dims: int, k: int) -> DataFrame:
    """The k best of each vector by what it meets in the cells that it visits in all tables; a task takes the queries of a file of the first table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                part = _part(files[0][at], ["id", "vec", "n"])
                if not part.num_rows:
                    continue
                block = _Block(part, dims, k)
                for t, paths in enumerate(files):
                    for some in (paths[at : at + 1], paths[at + 1 :] + paths[:at]):  # in the first table its own file first, for early bounds; and tasks don't all read the same
                        chances = tables.chances(block.exact, block.radius(), t)
                        for path in some:
                            block.meet(chances, path, len(tables.offsets[t]))
                yield block.found(part.column("n").to_numpy())

    n = len(files[0])
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, FOUND)


def _sorted(classes: DataFrame, tables: Tables, t: int, dims: int, parts: int) -> DataFrame:
    """(cell, id, vec, n) of all vectors in table ``t``, in about ``parts`` equal runs of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cells = tables.places(_matrix(part.column(1), dims), t)
                yield pa.record_batch([pa.array([c.tobytes() for c in cells], pa.binary()), *part.columns], names=["cell", "id", "vec", "n"])

    placed = classes.select("id", "vec", "n").mapInArrow(run, "cell binary, id bigint, vec array<float>, n bigint")
    return placed.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dims: int = 64, hashing: Hashing | None = None) -> DataFrame:
    """(id, near, sim, rank): the k most similar others of every usable vector by cosine; ties go to the smaller key.

    Usable are vectors of ``dims`` finite numbers that are not all zero; null, shorter, longer or non-finite ones and null
    keys have no rows and are no neighbours. Keys in several rows count once. Equal vectors are hashed and compared
    once, and each gets its own rows: a class of n equal vectors costs n rows of output a rank, not n squared.
    One usable vector alone, or none, gives no rows. Every vector is in the index, and no cell or block is cut short.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours", tidy=True)
    usable = scratch.keep(usable_vectors(df, key, vector, dims))
    classes = scratch.keep(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    several = classes.where("n > 1").select("vec", F.col("id").alias("rep"))
    shared = scratch.keep(usable.join(several, "vec").select("rep", "id"))
    scratch.drop(usable)
    rows = classes.count()
    tables = (hashing or Hashing()).fit(rows, *moments(classes, dims))
    parts = max(-(-rows // BLOCK), min(spark.sparkContext.defaultParallelism * 2, -(-rows // 1024)), 1)
    members = [scratch.keep(_sorted(classes, tables, t, dims, parts)) for t in range(len(tables.projections))]
    scratch.drop(classes)
    files = [sorted(m.inputFiles()) for m in members]
    near = scratch.keep(_visited(files, spark, tables, dims, k))
    scratch.drop(*members)
    plain = near.where("plain").select("id", "near", "sim", "rank")
    return plain.unionByName(_expand(near.where("not plain"), shared, k)) if shared.limit(1).count() else plain


def _expand(near: DataFrame, shared: DataFrame, k: int) -> DataFrame:
    """From classes of equal vectors to their members; of a class only its k + 1 smallest keys can be among k nearest."""
    w = Window.partitionBy("rep").orderBy("id")
    least = shared.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("rep", "id")
    own = shared.join(least.withColumnRenamed("id", "near"), "rep").where("id <> near").select("id", "near", F.lit(1.0).alias("sim"))
    of_one = near.where("near_n = 1").select(F.col("id").alias("rep"), "near", "sim", "n")
    of_many = near.where("near_n > 1").select(F.col("id").alias("rep"), F.col("near").alias("near_rep"), "sim", "n")
    of_many = of_many.join(least.select(F.col("rep").alias("near_rep"), F.col("id").alias("near")), "near_rep").select("rep", "near", "sim", "n")
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "near")
    other = of_one.unionByName(of_many).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    single = other.where("n = 1").select(F.col("rep").alias("id"), "near", "sim")
    found = single.unionByName(shared.join(other.where("n > 1"), "rep").select("id", "near", "sim")).unionByName(own)
    last = Window.partitionBy("id").orderBy(F.desc("sim"), "near")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def similar_pairs(near: DataFrame) -> DataFrame:
    """(low_id, high_id): each pair once of which one is among the nearest of the other."""
    return near.select(F.least("id", "near").alias("low_id"), F.greatest("id", "near").alias("high_id")).distinct()
