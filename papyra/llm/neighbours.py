"""Most similar vectors for every vector, by a permutation index.

Pivots are a sample by a hash of the ids, of about ``12 sqrt(n)`` vectors and at most ``MAX_PIVOTS`` (reached at 119 million
vectors): the broadcast is bounded by MAX_PIVOTS vectors. Up to ``FLAT`` pivots a vector is compared with all of them; more are
found in two levels, by the groups of pivots whose centres are nearest, so that the search costs a vector about the square root of their number. Every vector is indexed. The pivots are cut into cells by balanced bisection, and a vector travels to the
cells of its ``probes`` nearest pivots, where it is both posted and asked for. In a cell every query is compared with every
vector, in tiles, so two vectors meet wherever they share a pivot or a cell, whatever their number, and nothing is compared with
all. For pairs above a threshold, pivots joined by cosines above it stay in one cell. As pivots are a sample, they tell how many
vectors a cell will get: a cell that would exceed ``BLOCK`` (many near or exact copies of one vector, say) is cut into blocks by
a hash of the id, and every block of queries meets every block of vectors there.

The index is exact for what meets in a cell and misses what does not; ``exact_neighbours`` is the exact way for a stated set of
queries: they are compared with all vectors, in blocks, and recall is measured against it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIVOTS, FLAT, BLOCK = 131_072, 8192, 30_000
#: Queries compared at a time with a cell's vectors, columns of which only the largest is looked at first, pairs made exact at a time, and what a cosine in single precision may be off.
TILE, SPAN, STEP, SLACK = 128, 64, 100_000, 1e-5


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column and these vectors, normalised."""
    lists = column.cast(pa.list_(pa.float32()))
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.flatnonzero((sizes == dim) & ~np.asarray(lists.is_null()))
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = lists.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    x = flat[lists.offsets.to_numpy()[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], (x[good] / norms[good][:, None]).astype(np.float32)


def _bisect(pivots: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each pivot: halves by the direction of most variance, until there are ``cells`` (a power of two)."""
    out = np.zeros(len(pivots), dtype=np.int32)
    parts = [np.arange(len(pivots))]
    while len(parts) < cells:
        halves = []
        for part in parts:
            x = pivots[part] - pivots[part].mean(axis=0)
            _, _, vt = np.linalg.svd(x, full_matrices=False)
            order = part[np.argsort(x @ vt[0], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    for c, part in enumerate(parts):
        out[part] = c
    return out


def _groups(pivots: np.ndarray, threshold: float) -> np.ndarray:
    """The first pivot of each pivot's group: those that a chain of cosines from ``threshold`` on connects."""
    out = np.full(len(pivots), -1, dtype=np.int64)
    for i in range(len(pivots)):
        front = np.array([i]) if out[i] < 0 else np.zeros(0, np.int64)
        while len(front):
            out[front] = i
            free = np.flatnonzero(out < 0)
            front = free[np.concatenate([(pivots[free] @ pivots[front[k : k + TILE]].T).max(axis=1, keepdims=True) for k in range(0, len(front), TILE)], axis=1).max(axis=1) >= threshold]
    return out


class Nearest:
    """The ``count`` nearest pivots of vectors: among all, or among those of the nearest groups of pivots."""

    def __init__(self, pivots: np.ndarray, count: int, flat: int):
        self.pivots, self.count = pivots, min(count, len(pivots))
        self.groups: list[np.ndarray] = []
        if len(pivots) > flat:
            parts = 1 << max(1, round(math.log2(math.sqrt(len(pivots)))))
            group = _bisect(pivots, parts)
            self.groups = [np.flatnonzero(group == g) for g in range(parts)]
            centres = np.stack([pivots[g].mean(axis=0) for g in self.groups])
            self.centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)
            # groups looked into: with fewer, pivots just beyond the border of a group would be missed
            self.beam = min(parts, max(16, parts // 8))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.groups:
            near = x @ self.pivots.T
            return np.argpartition(near, len(self.pivots) - self.count, axis=1)[:, -self.count :] if self.count < len(self.pivots) else np.tile(np.arange(self.count), (len(x), 1))
        to = x @ self.centres.T
        chosen = np.argpartition(to, len(self.groups) - self.beam, axis=1)[:, -self.beam :] if self.beam < len(self.groups) else np.tile(np.arange(self.beam), (len(x), 1))
        best = np.full((len(x), self.count), -np.inf, np.float32)
        names = np.zeros((len(x), self.count), np.int64)
        order = np.argsort(chosen, axis=None, kind="stable")
        rows, of = order // self.beam, chosen.ravel()[order]
        for g in np.unique(of):
            own = rows[np.searchsorted(of, g) : np.searchsorted(of, g, side="right")]
            members = self.groups[g]
            both = np.concatenate([best[own], x[own] @ self.pivots[members].T], axis=1)
            which = np.concatenate([names[own], np.tile(members, (len(own), 1))], axis=1)
            top = np.argpartition(both, both.shape[1] - self.count, axis=1)[:, -self.count :]
            best[own], names[own] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
        return names


def _best(near: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that hold the ``count`` largest of each row and all about as large as the last of these, in order of rows."""
    n, m = near.shape
    w = m // SPAN
    if w < count:
        if m > count:
            return np.nonzero(near >= np.partition(near, m - count, axis=1)[:, m - count, None] - SLACK)
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    # one column of each span is its largest, so the count-th of these is no more than the count-th of all
    spans = near[:, : w * SPAN].reshape(n, SPAN, w)
    peaks = spans.max(axis=1)
    least = np.partition(peaks, w - count, axis=1)[:, w - count] - SLACK
    r, g = np.nonzero(peaks >= least[:, None])
    i, j = np.nonzero(spans[r, :, g] >= least[r][:, None])
    rest, tail = np.nonzero(near[:, w * SPAN :] >= least[:, None])
    rows, cols = np.concatenate([r[i], rest]), np.concatenate([j * w + g[i], tail + w * SPAN])
    by = np.argsort(rows, kind="stable")
    return rows[by], cols[by]


def _search(df: DataFrame, id: str, vector: str, dim: int, probes: int, top: int, threshold: float | None, flat: int = FLAT) -> DataFrame:
    """(id, neighbours, cosines) as found in each block: at most ``top`` for each query and block, or all from ``threshold`` on."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("string").alias("id"), F.col(vector).alias("v")).filter("id is not null").filter(F.size("v") == dim)
    n = max(1, rows.count())
    wanted = min(MAX_PIVOTS, max(64, int(12 * math.sqrt(n))))
    share = 1 << 30
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) < int(min(1.0, 1.3 * wanted / n) * share)).dropDuplicates(["id"])
    sample = sorted(sample.select(F.xxhash64("id", F.lit(7)).alias("h"), "id", "v").toArrow().to_pylist(), key=lambda r: (r["h"], r["id"]))
    _, drawn = _unit(pa.array([r["v"] for r in sample], pa.list_(pa.float32())), dim)
    drawn = drawn[:wanted] if len(drawn) else np.eye(1, dim, dtype=np.float32)
    pivots, copies = np.unique(drawn, axis=0, return_counts=True)
    probes = min(probes, len(pivots))
    some = np.linspace(0, len(pivots) - 1, min(len(pivots), 1024)).astype(np.int64)
    nearest = Nearest(pivots, probes, flat)(pivots[some])
    # near copies would be parted by any cut between them
    groups = _groups(pivots, threshold) if threshold is not None else np.arange(len(pivots))
    cells = 1
    while True:
        cell_of = _bisect(pivots, cells)[groups]
        marks = np.zeros((len(some), cells), dtype=bool)
        np.put_along_axis(marks, cell_of[nearest], True, axis=1)
        expected = (marks * copies[some][:, None]).sum(axis=0) * (n / copies[some].sum())
        if expected.mean() <= BLOCK or cells * 8 > len(pivots):
            break
        cells *= 2
    blocks = np.maximum(1, np.ceil(expected / (2 * BLOCK))).astype(np.int64)
    shared = spark.sparkContext.broadcast((Nearest(pivots, probes, flat), cell_of, blocks))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cell_of, blocks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                kept, x = _unit(part.column(1), dim)
                if not len(kept):
                    continue
                order = find(x)
                salt = part.column(2).to_numpy()[kept]
                src, group, vectors, queries, before = [], [], [], [], []
                for i, own in enumerate(cell_of[order].tolist()):
                    own = sorted(set(own))
                    for nth, c in enumerate(own):
                        b = int(blocks[c])
                        before += [np.array(own[:nth] + [-1] * (probes - nth), "<i2").tobytes()] * (1 if b == 1 else 2 * b - 1)
                        if b == 1:
                            src.append(i), group.append((c, 0, 0)), vectors.append(True), queries.append(True)
                            continue
                        s = int(salt[i] % b)
                        # as a vector its block meets all blocks of queries, as a query all blocks of vectors
                        for o in range(b):
                            src.append(i), group.append((c, s, o)), vectors.append(True), queries.append(o == s)
                            if o != s:
                                src.append(i), group.append((c, o, s)), vectors.append(False), queries.append(True)
                src = np.array(src)
                raw = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(src))
                ids = part.column(0).take(pa.array(kept[src]))
                g = np.array(group, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(g[:, j]) for j in range(3)), ids, raw, pa.array(before, pa.binary()), pa.array(vectors), pa.array(queries)], names=["c", "vb", "qb", "id", "x", "o", "is_v", "is_q"])

    posted = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("s")).mapInArrow(post, "c int, vb int, qb int, id string, x binary, o binary, is_v boolean, is_q boolean")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        ids = np.array(group.column("id").to_pylist(), dtype=object)
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), dtype="<f4").reshape(-1, dim)
        o = np.frombuffer(b"".join(group.column("o").to_pylist()), dtype="<i2").reshape(len(x), -1)
        v, q = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("is_v", "is_q"))
        # repeated rows meet here, as they have one id and one vector
        v = np.array([i for _, i in sorted({(ids[i], x[i].tobytes()): i for i in v}.items())], dtype=np.int64)
        q = np.array([i for _, i in sorted({(ids[i], x[i].tobytes()): i for i in q}.items())], dtype=np.int64)
        if not len(v) or not len(q):
            return
        names, base, texts = ids[v], x[v], pa.array(ids[v], pa.string())
        for at in range(0, len(q), TILE):
            asked = q[at : at + TILE]
            # names are in order, and so are those asked
            own, after = (np.searchsorted(names, ids[asked], side=side) for side in ("left", "right"))
            if threshold is not None:
                # the pair's other half is found from its own side
                first = int(after[0])
                rows, cols = np.nonzero(x[asked] @ base[first:].T >= threshold - SLACK)
                cols = cols + first
                others = cols >= after[rows]
            else:
                rows, cols = _best(x[asked] @ base.T, top + int((after - own).max()))
                others = (cols < own[rows]) | (cols >= after[rows])
            rows, cols = rows[others], cols[others]
            # single precision proposes, double precision decides, so that a pair is judged alike wherever it meets
            exact = np.concatenate([np.zeros(0), *((base[cols[i : i + STEP]].astype(np.float64) * x[asked[rows[i : i + STEP]]].astype(np.float64)).sum(axis=1) for i in range(0, len(rows), STEP))])
            if threshold is not None:
                kept = np.flatnonzero(exact >= threshold)
            else:
                kept = np.lexsort((cols, -exact, rows))
                kept = kept[np.arange(len(rows)) - np.searchsorted(rows, rows) < top]
                # of two that share an earlier cell, that one gives the pair, or ``top`` better ones
                mine, theirs = o[asked[rows[kept]]], o[v[cols[kept]]]
                kept = kept[~((mine[:, :, None] == theirs[:, None, :]) & (mine[:, :, None] >= 0)).any(axis=(1, 2))]
            rows, cols, exact = rows[kept], cols[kept], exact[kept]
            bounds = np.append(np.unique(rows, return_index=True)[1], len(rows)).astype(np.int32)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[asked[rows[bounds[:-1]]]], pa.string()), pa.ListArray.from_arrays(pa.array(bounds), texts.take(pa.array(cols))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(exact))], names=["id", "neighbours", "cosines"]
                )

    # one partition holds a few groups; their number follows the number of vectors
    parts = max(1, min(20_000, 2 * int((blocks**2).sum())))
    return posted.repartition(parts, "c", "vb", "qb").groupBy("c", "vb", "qb").applyInArrow(solve, "id string, neighbours array<string>, cosines array<double>")


def exact_neighbours(queries: DataFrame, df: DataFrame, id: str = "id", vector: str = "embedding", dim: int = 64, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbour, cosine) of a stated set of queries (id, vector), compared with all vectors of ``df``, in blocks.

    Usable vectors and ties are those of ``nearest_neighbours``. Queries are broadcast ``block`` at a time, so more of them mean
    more passes; each task keeps the ``top`` of its vectors for each query, and these are merged.
    """
    spark = df.sparkSession
    asked = queries.select(F.col(id).cast("string").alias("id"), F.col(vector).alias("v")).filter("id is not null").filter(F.size("v") == dim).distinct()
    rows = df.select(F.col(id).cast("string").alias("id"), F.col(vector).alias("v")).filter("id is not null").filter(F.size("v") == dim)
    parts = max(1, -(-asked.count() // block))
    found = []
    for part in range(parts):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        kept, q = _unit(got.column("v").combine_chunks(), dim) if got.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
        shared = spark.sparkContext.broadcast((np.array(got.column("id").to_pylist(), dtype=object)[kept], q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best: list[list[tuple[float, str]]] = [[] for _ in names]
            for batch in batches:
                at, x = _unit(batch.column(1), dim)
                if not len(at):
                    continue
                ids = np.array(batch.column(0).to_pylist(), dtype=object)[at]
                for low in range(0, len(names), TILE):
                    near = q[low : low + TILE] @ x.T
                    r, c = _best(near, top + 1)
                    exact = (q[low + r].astype(np.float64) * x[c].astype(np.float64)).sum(axis=1)
                    for k in np.unique(r):
                        own = r == k
                        merged = {(-v, n) for v, n in zip(exact[own].tolist(), ids[c[own]].tolist()) if n != names[low + k]} | set(best[low + k])
                        best[low + k] = sorted(merged)[:top]
            rows = [(n, i, -v) for n, b in zip(names, best) for v, i in b]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["id", "n", "c"])

        found.append(rows.mapInArrow(run, "id string, n string, c double"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    hits = out.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("c")).alias("c"), "n")))), 1, top).alias("hits"))
    return hits.select("id", F.posexplode("hits").alias("rank", "h")).select("id", (F.col("rank") + 1).alias("rank"), F.col("h.n").alias("neighbour"), (-F.col("h.c")).alias("cosine"))


def nearest_neighbours(df: DataFrame, id: str = "id", vector: str = "embedding", dim: int = 64, top: int = 10, probes: int = 12, flat: int = FLAT) -> DataFrame:
    """(id, rank, neighbour, cosine): the ``top`` most similar other vectors of each usable vector; ties go to the smaller id.

    Vectors that are null, not ``dim`` long, all zero or contain a null, NaN or an infinite number, and rows without an id are
    left out. A repeated row counts once. Of an id with several vectors all are searched and it never is its own neighbour.
    """
    found = _search(df, id, vector, dim, probes, top, None, flat)
    # a query has one row for each block it was asked in, with at most ``top`` hits: few, whatever the number of vectors
    pairs = F.arrays_zip(F.transform("cosines", lambda c: -c).alias("c"), F.col("neighbours").alias("n"))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, top).alias("hits"))
    return best.select("id", F.posexplode("hits").alias("rank", "h")).select("id", (F.col("rank") + 1).alias("rank"), F.col("h.n").alias("neighbour"), (-F.col("h.c")).alias("cosine"))


def similar_pairs(df: DataFrame, threshold: float = 0.9, id: str = "id", vector: str = "embedding", dim: int = 64, probes: int = 4) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: pairs of different ids with a cosine of at least ``threshold``.

    The same vectors are left out as in ``nearest_neighbours``. A query is compared with all vectors of its cells, so the number
    of partners is not limited.
    """
    found = _search(df, id, vector, dim, probes, 0, threshold).select("id", F.explode("neighbours").alias("neighbour"))
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
