"""Exact top-k search by inner product with an index of pivots and distances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.llm.integers import LONGS, finite, firsts, largest, lengths, matrix, products, quantised, to_long
from marketweek.llm.storage import ship, staged

SCALE, TOP = 64, 20
#: Pivots are a sample as large as the root of the number of vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 16, 1024
#: Vectors of a section (a task's share of the index) and of an annulus; queries that meet a section at once.
MIN_SECTION, MAX_SECTION, MAX_SECTIONS, ANNULUS, SLICE = 4096, 65536, 65536, 512, 65536
#: Bytes of a section, and entries of a matrix held at once.
SECTION_BYTES, CELLS = 1 << 25, 1 << 21
#: Bits for the number of a section beside its length.
DIM_SHIFT = 32
#: What rounding of distances may add to a bound, as a share of the squares that enter it.
ROUNDING = 1e-6

KEYED = "dim int, pivot int, dist double, vec_id long, v array<long>"
SECTIONS = (
    "section long, dim int, n long, n_queries long, pivots array<int>, lows array<double>, highs array<double>, "
    "norms array<double>, sizes array<int>, ids binary, vs binary"
)
QUERIES = "home long, q int, dim int, query_id long, least long, v array<long>, found array<struct<vec_id:long,score:long>>"
DEALT = "section long, slice int, home long, q int, query_id long, least long, dim int, v array<long>"
FOUND = "home long, q int, query_id long, vec_id long, score long"


def squares(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x * x).sum(axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    cross = x.astype(np.float64) @ pivots.astype(np.float64).T
    return np.sqrt(np.maximum(0, squares(x)[:, None] + squares(pivots) - 2 * cross))


def bounds(near: np.ndarray, norm: np.ndarray, lows: np.ndarray, highs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The highest score that a row may have in each annulus, by row and annulus.

    With ``d`` the distance of query and vector, the score is ``(|q|^2 + |x|^2 - d^2) / 2``, and
    by the triangle inequality ``d`` is at least the gap between the query's distance to the
    pivot (``near``) and the annulus. ``norm`` and ``norms`` are squares.
    """
    gap = np.maximum(0, np.maximum(near - highs, lows - near))
    reach = norm[:, None] + norms
    return (reach - gap * gap) / 2 + ROUNDING * (reach + near * near)


def batches_by_length(batches, *names):
    """``(dim, columns...)`` of the rows of each length in each batch."""
    import pyarrow.compute as pc

    for batch in batches:
        dims = batch.column("dim")
        for dim in pc.unique(dims).to_pylist():
            part = batch if len(pc.unique(dims)) == 1 else batch.filter(pc.equal(dims, dim))
            yield dim, *(part.column(name) for name in names)


def lists(x: np.ndarray):
    """Rows of a matrix as an Arrow list column."""
    import pyarrow as pa

    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.reshape(-1), pa.int64()))


def keyed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with its nearest pivot and the distance to it."""

    def run(batches):
        import pyarrow as pa

        for dim, ids, vs in batches_by_length(batches, "vec_id", "v"):
            v, own = matrix(vs, dim), pivots.get(dim, np.zeros((1, dim), np.int64))
            step = max(1, CELLS // len(own))
            for lo in range(0, len(v), step):
                d = distances(v[lo : lo + step], own)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(d), dim, np.int32)), pa.array(home.astype(np.int32)),
                        pa.array(d[np.arange(len(d)), home]), ids[lo : lo + step], lists(v[lo : lo + step]),
                    ],
                    names=["dim", "pivot", "dist", "vec_id", "v"],
                )

    return rows.select("vec_id", "dim", "v").mapInArrow(run, KEYED)


def annuli_of(pivot: np.ndarray) -> np.ndarray:
    """First rows of the annuli: runs of one pivot, cut after ``ANNULUS`` rows."""
    start = np.flatnonzero(np.concatenate([[True], np.diff(pivot) != 0]))
    size = np.diff(np.concatenate([start, [len(pivot)]]))
    return np.concatenate([np.arange(s, s + n, ANNULUS) for s, n in zip(start, size)])


def placed(index: DataFrame) -> DataFrame:
    """Rows of the sorted index with their place among those of their length in their task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), {}
        for dim, *columns in batches_by_length(batches, "pivot", "dist", "vec_id", "v"):
            n, first = len(columns[0]), before.get(dim, 0)
            before[dim] = first + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n)),
                    pa.array(np.full(n, dim, np.int32)), *columns,
                ],
                names=["part", "place", "dim", "pivot", "dist", "vec_id", "v"],
            )

    return index.mapInArrow(run, "part int, place long, " + KEYED)


def sections(index: DataFrame, limit: int, every: int) -> DataFrame:
    """Neighbouring vectors of the sorted index as one row, cut into annuli around pivots.

    All sections of a length but its last have ``limit`` vectors (fewer where these would take
    more than ``SECTION_BYTES``), however the sorted rows lie in tasks.
    """
    size = F.least(F.lit(limit), F.greatest(F.lit(1), F.floor(F.lit(SECTION_BYTES // 8) / F.greatest(F.lit(1), "dim"))))
    counts = index.groupBy("dim", "part").agg(F.count("*").alias("rows"))
    # One row a task and length.
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("dim").alias("d"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    same = (F.col("dim") == F.col("d")) & (F.col("part") == F.col("p"))
    number = F.shiftleft(F.col("dim").cast("long"), DIM_SHIFT) + F.floor((F.col("start") + F.col("place")) / size)
    rows = index.join(starts, same).select(number.cast("long").alias("section"), "dim", "pivot", "dist", "vec_id", "v")

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("pivot", "ascending"), ("dist", "ascending"), ("vec_id", "ascending")])
        dim = table.column("dim")[0].as_py()
        pivot, dist, ids = (table.column(c).to_numpy() for c in ("pivot", "dist", "vec_id"))
        v = matrix(table.column("v"), dim)
        first = annuli_of(pivot)
        last = np.concatenate([first[1:], [len(pivot)]])
        row = {
            "section": table.column("section")[0].as_py(), "dim": dim, "n": len(ids),
            "n_queries": int((ids % every == 0).sum()), "pivots": pivot[first], "lows": dist[first],
            "highs": dist[last - 1], "norms": np.maximum.reduceat(squares(v), first), "sizes": last - first,
            "ids": ids.tobytes(), "vs": v.tobytes(),
        }
        schema = pa.schema([
            ("section", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("n_queries", pa.int64()),
            ("pivots", pa.list_(pa.int32())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())),
            ("norms", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("vs", pa.binary()),
        ])
        return pa.Table.from_pylist([row], schema)

    return rows.groupBy("section").applyInArrow(run, SECTIONS)


class Best:
    """The best ``k`` candidates so far of each of ``n`` queries, by score and then smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), LONGS.min, np.int64), np.full((n, k), LONGS.max, np.int64)

    def add(self, queries: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """At most ``k`` new candidates for each of ``queries``; ``row`` ascends."""
        if scores.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        n = np.bincount(row, minlength=len(queries))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.k
        score = np.concatenate([self.score[queries], np.full((len(queries), self.k), LONGS.min, self.score.dtype)], 1)
        id_ = np.concatenate([self.id[queries], np.full((len(queries), self.k), LONGS.max)], 1)
        filled = np.concatenate([np.arange(self.k) < self.count[queries, None], np.arange(self.k) < n[:, None]], 1)
        score[row, place], id_[row, place] = scores, ids
        if score.dtype == object:
            order = np.array([
                sorted(range(2 * self.k), key=lambda c, r=r: (not filled[r, c], -score[r, c], id_[r, c])) for r in range(len(queries))
            ], np.int64).reshape(len(queries), 2 * self.k)
        else:
            # The complement turns the order around without overflow.
            order = np.lexsort((id_, ~score, ~filled), axis=1)
        order = order[:, : self.k]
        self.score[queries], self.id[queries] = np.take_along_axis(score, order, 1), np.take_along_axis(id_, order, 1)
        self.count[queries] = np.minimum(self.k, self.count[queries] + n)

    def last(self, queries: np.ndarray) -> np.ndarray:
        return self.score[queries, self.k - 1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, vec_id, score)``, queries ascending, best first."""
        row, col = np.nonzero(np.arange(self.k) < self.count[:, None])
        return row, self.id[row, col], to_long(self.score[row, col])


class Section:
    """A section's vectors and annuli in memory."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.v = np.frombuffer(row["vs"], np.int64).reshape(len(self.ids), row["dim"])
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.pivots = np.asarray(row["pivots"], np.int64)
        self.lows, self.highs, self.norms = (np.asarray(row[c], float) for c in ("lows", "highs", "norms"))

    def search(self, ids: np.ndarray, v: np.ndarray, least: np.ndarray, has: np.ndarray, pivots: np.ndarray, k: int):
        """``(query, vec_id, score)`` of each query's ``k`` best here that reach its ``least``.

        Annuli are expanded from the highest bound down. A query leaves out an annulus whose
        bound is below the ``k``-th score it has so far (``least``, where it ``has`` one), and
        the search stops when no annulus is left to any query.
        """
        best = Best(len(ids), k)
        least, has = least.astype(object), has.copy()
        # Longs wherever the products are, Python integers only where longs could overflow.
        if largest(v) * largest(self.v) * max(1, v.shape[1]) <= LONGS.max:
            least = least.astype(np.int64)
        reach = bounds(distances(v, pivots[self.pivots]), squares(v), self.lows, self.highs, self.norms)
        for a in np.argsort(-reach.max(axis=0), kind="stable") if len(ids) else ():
            # Comparisons with NaN, of huge components, leave nothing out.
            active = np.flatnonzero(~(has & (reach[:, a] < least.astype(float))))
            part = slice(self.ends[a] - self.sizes[a], self.ends[a])
            order = np.argsort(self.ids[part], kind="stable")
            cand, x = self.ids[part][order], self.v[part][order]
            step = max(1, CELLS // max(1, len(cand)))
            for lo in range(0, len(active), step):
                some = active[lo : lo + step]
                score = products(v[some], x)
                allowed = (ids[some][:, None] != cand) & (~has[some][:, None] | (score >= least[some][:, None]))
                hit = np.flatnonzero(allowed.any(axis=1))
                some, score, allowed = some[hit], score[hit], allowed[hit]
                row, col = firsts(score, allowed, k)
                best.add(some, row, cand[col], score[row, col])
                full = some[best.count[some] == k]
                least[full], has[full] = best.last(full), True
        return best.rows()


def at_home(index: DataFrame, pivots: dict[int, np.ndarray], every: int, k: int) -> DataFrame:
    """The queries among the vectors, each searched in its own section first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                here, dim = Section(row), row["dim"]
                place = np.flatnonzero(here.ids % every == 0)
                # Bounded parts, so that no list of results of a whole section is held.
                for lo in range(0, len(place), 4096):
                    mine = place[lo : lo + 4096]
                    ids, v = here.ids[mine], here.v[mine]
                    none = np.zeros(len(ids), np.int64)
                    q, c, s = here.search(ids, v, none, none > 0, pivots.get(dim, np.zeros((1, dim), np.int64)), k)
                    count = np.bincount(q, minlength=len(ids))
                    ends = np.concatenate([[0], np.cumsum(count)])
                    full = count == k
                    found = pa.StructArray.from_arrays([pa.array(c), pa.array(s)], ["vec_id", "score"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(ids), row["section"])), pa.array(mine.astype(np.int32)),
                            pa.array(np.full(len(ids), dim, np.int32)), pa.array(ids),
                            pa.array(s[np.maximum(ends[1:] - 1, 0)] if len(s) else none, mask=~full), lists(v),
                            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found),
                        ],
                        names=["home", "q", "dim", "query_id", "least", "v", "found"],
                    )

    return index.mapInArrow(run, QUERIES)


def dealt(queries: DataFrame, summary: dict, slices: dict[int, int], pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each query once for every other section where some annulus may hold a better vector."""

    def run(batches):
        import pyarrow as pa

        for dim, qs, homes, ids, leasts, vs in batches_by_length(batches, "q", "home", "query_id", "least", "v"):
            names, place, own, lows, highs, norms = summary[dim]
            points = pivots.get(dim, np.zeros((1, dim), np.int64))
            v, home, has = matrix(vs, dim), homes.to_numpy(), leasts.is_valid().to_numpy(zero_copy_only=False)
            least = leasts.fill_null(0).to_numpy()
            step = max(1, CELLS // (len(own) + len(points)))
            for lo in range(0, len(v), step):
                part = slice(lo, lo + step)
                near = distances(v[part], points)[:, own]
                open_ = ~(has[part, None] & (bounds(near, squares(v[part]), lows, highs, norms) < least[part, None]))
                # The entries of a section lie side by side.
                visit = np.logical_or.reduceat(open_, place, axis=1) & (names != home[part, None])
                row, section = np.nonzero(visit)
                row += lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[section]),
                        pa.array(np.array([slices[h] for h in home[row].tolist()], np.int32), pa.int32()),
                        homes.take(pa.array(row)), qs.take(pa.array(row)), ids.take(pa.array(row)), leasts.take(pa.array(row)),
                        pa.array(np.full(len(row), dim, np.int32)), lists(v[row]),
                    ],
                    names=["section", "slice", "home", "q", "query_id", "least", "dim", "v"],
                )

    return queries.select("home", "q", "dim", "query_id", "least", "v").mapInArrow(run, DEALT)


def visited(sections_: DataFrame, dealt_: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """What the dealt queries find in the sections they visit."""

    def run(left, right):
        import pyarrow as pa

        out = [np.zeros(0, np.int64), np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3]
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            here, dim = Section(row), row["dim"]
            least = right.column("least").combine_chunks()
            ids, q, home = (right.column(c).to_numpy() for c in ("query_id", "q", "home"))
            of, c, s = here.search(
                ids, matrix(right.column("v"), dim), least.fill_null(0).to_numpy(),
                least.is_valid().to_numpy(zero_copy_only=False), pivots.get(dim, np.zeros((1, dim), np.int64)), k,
            )
            out = [home[of], q[of], ids[of], c, s]
        return pa.table(dict(zip(("home", "q", "query_id", "vec_id", "score"), out)))

    pairs = staged(dealt_.select("section", "slice").distinct(), "visits")
    left = sections_.join(pairs, "section").groupBy("section", "slice")
    return left.cogroup(dealt_.groupBy("section", "slice")).applyInArrow(run, FOUND)


def overview(index: DataFrame) -> tuple[dict, dict[int, int]]:
    """Per length the sections' distance ranges by pivot, and the slice of each section's queries.

    At most ``MAX_SECTIONS`` sections (but for lengths of their own) with one range a pivot that
    they touch; neighbouring sections share pivots, so there are no more ranges than sections
    and pivots together.
    """
    entry = F.arrays_zip("pivots", "lows", "highs", "norms")
    ranges = (
        index.select("section", "dim", F.explode(entry).alias("e"))
        .groupBy("section", "dim", "e.pivots")
        .agg(F.min("e.lows").alias("low"), F.max("e.highs").alias("high"), F.max("e.norms").alias("norm"))
        .orderBy("dim", "section", "pivots")
    )
    by_dim: dict[int, list] = {}
    for r in ranges.collect():
        by_dim.setdefault(r["dim"], []).append((r["section"], r["pivots"], r["low"], r["high"], r["norm"]))
    out = {}
    for dim, rows in by_dim.items():
        section, own, low, high, norm = (np.array(x) for x in zip(*rows))
        place = np.flatnonzero(np.concatenate([[True], np.diff(section) != 0]))
        out[dim] = section[place], place, own, low, high, norm
    slices, before = {}, 0
    for r in index.select("section", "n_queries").orderBy("section").collect():
        slices[r["section"]] = before // SLICE
        before += r["n_queries"]
    return out, slices


def top_products(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = TOP,
                 every: int = 20, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of every query, exact.

    Components become ``floor(scale * x)``. Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but those with the query's id; ties go to the smaller id.

    The index keys every vector by its nearest pivot (a bounded sample, at most ``MAX_PIVOTS``)
    and its distance to it, sorted into sections of annuli of bounded size however crowded a
    pivot is. A query first searches its own section; its ``k``-th score there then bounds,
    by the triangle inequality, the annuli elsewhere that can matter, and it is dealt only to
    sections that hold one. No row is left out by anything but such a bound. Vectors without
    structure aren't separated by any bound; then all sections are visited, in blocks.

    Rows without id, null vectors and vectors with null or non-finite components take no part;
    zero and empty vectors do. Vectors of different lengths are never compared. Rows that
    repeat id and vector count once; rows that share an id but differ are each candidates, and
    queries of their own under the same id. Components and scores beyond a long become the
    nearest long. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite("v")).select("vec_id", quantised("v", scale).alias("v"))
    table = staged(rows.distinct().withColumn("dim", F.size("v")), "integer-vectors")
    n = sum(lengths(table).values())
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(math.sqrt(n))))
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(wanted).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.unique(np.array(v, np.int64).reshape(len(v), dim), axis=0)[: max(1, len(v))] for dim, v in by_dim.items()}
    limit = max(MIN_SECTION, min(MAX_SECTION, n // 64), math.ceil(n / MAX_SECTIONS))
    order = ["dim", "pivot", "dist", "vec_id"]
    index = staged(keyed(table, pivots), "pivot-keys").repartitionByRange(max(1, math.ceil(n / limit)), *order)
    index = staged(placed(index.sortWithinPartitions(*order)), "sorted-keys")
    index = staged(sections(index, limit, every), "sections")
    summary, slices = overview(index)
    queries = staged(at_home(index, pivots, every, k), "queries")
    away = visited(index, dealt(queries, summary, slices, pivots), pivots, k)
    home = queries.select("home", "q", "query_id", F.explode("found").alias("f"))
    home = home.select("home", "q", "query_id", "f.vec_id", "f.score")
    order = Window.partitionBy("home", "q").orderBy(F.desc("score"), "vec_id")
    return (
        home.union(away)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
