"""The best rows to each of many queries by all their products, as matrices in tasks of bounded size.

Rows and queries are dealt into parts; each part of rows meets each part of
queries once, in a task that multiplies tile by tile and keeps the k best of a
query. What a task holds doesn't grow with the tables; what all tasks compute
grows with rows times queries, since each pair is compared.

Vectors of few terms (``best_shared_products``) are put into an order in which
those of the same terms are neighbours: a tile of rows and a block of queries
are multiplied over the terms that both have, in 32 bits, and only what may be
among the k best is multiplied again in 64. Neither the order nor the 32 bits
change what is found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a task at most, about.
PART_ROWS, QUERY_ROWS = 50_000, 16_384
#: Rows are dealt into as many parts even if they would fit into fewer.
LEAST_PARTS = 24
#: Rows that are multiplied at a time.
TILE_ROWS = 512
#: Rows and queries of a task at most, about, and queries that are multiplied at a time, where vectors have few terms.
SHARED_ROWS, SHARED_QUERIES, BLOCK_QUERIES = 40_000, 32_768, 2048
#: Places that such vectors are ordered around, and how many of a part they are found on. The result doesn't depend on them.
PLACES, PLACE_ROWS = 16, 2048
#: A term in fewer of a place's rows is a stray: rows with many of them are put together.
STRAY = 0.02


def _comparer(k: int, places: int, distance: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What a task runs, sent by value with all that it needs."""
    names = ["g", "q", "id", "score"]

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        """A row for each vector."""
        held = column.combine_chunks()
        return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), width)

    def k_best(asked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, value): of each query the k rows of largest value, rounded; ties go to the earlier row."""
        n, base = len(asked), 1.0 if distance else 0.0
        least = np.full(n, -np.inf)
        own, row, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(at), TILE_ROWS):
            s = asked @ at[start : start + TILE_ROWS].T
            edge = least + base
            if start == 0 and s.shape[1] > k:
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            q, r = np.nonzero(s >= (edge - 10.0**-places)[:, None])
            if not len(q):
                continue
            # plus 0.0, since -0.0 and 0.0 are the same score
            found = (-np.round(1 - s[q, r], places) if distance else np.round(s[q, r], places)) + 0.0
            own, row, value = np.concatenate([own, q]), np.concatenate([row, r + start]), np.concatenate([value, found])
            order = np.lexsort((row, -value, own))
            own, row, value = own[order], row[order], value[order]
            first = np.searchsorted(own, np.arange(n))
            keep = np.arange(len(own)) - first[own] < k
            own, row, value = own[keep], row[keep], value[keep]
            held = np.bincount(own, minlength=n)
            full = held == k
            least[full] = value[(np.cumsum(held) - 1)[full]]
        return own, row, -value if distance else value

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([left.column("g").slice(0, 0), right.column("q").slice(0, 0), left.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        if not left.num_rows or not right.num_rows:
            return none
        wide, out = key[0].as_py(), [none]
        left = left.take(pc.sort_indices(left, sort_keys=[("g", "ascending"), ("id", "ascending")]))
        at, held = matrix(right.column("u"), wide), left.column("g").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
        for a, b in zip(cuts, cuts[1:]):
            own, row, score = k_best(at, matrix(left.column("v").slice(a, b - a), wide))
            row = pa.array(row + a)
            out.append(pa.table([left.column("g").take(row), right.column("q").take(pa.array(own)), left.column("id").take(row), pa.array(score)], names))
        return pa.concat_tables(out)

    return compare


def best_products(rows: DataFrame, queries: DataFrame, k: int, places: int, distance: bool = False) -> DataFrame:
    """(g, q, id, score): for each query (q, v) and group g of the rows (g, id, v) at least its k best rows, the best of each part.

    Scores are products rounded to ``places``, or with ``distance`` 1 less the
    product, small ones first; ties go to the smaller id. Vectors are arrays of
    numbers, of which those of one length meet; null vectors are left out.
    """
    rows, queries = rows.filter("v IS NOT NULL").withColumn("w", F.size("v")), queries.filter("v IS NOT NULL").withColumn("w", F.size("v"))
    blocks = -(-queries.count() // QUERY_ROWS) or 1
    n = rows.count()
    each = max(1, min(PART_ROWS, -(-n // LEAST_PARTS)))
    parts = max(1, -(-n // each))
    # a group's rows go to as many parts as they fill, so that few parts have rows of it
    fills = rows.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / each).cast("int").alias("fills"))
    part = F.pmod(F.xxhash64("g") + F.pmod(F.xxhash64("id"), F.col("fills")), F.lit(parts)).cast("int")
    dealt = rows.join(fills, F.col("g").eqNullSafe(F.col("_g"))).select("g", "id", "v", "w", part.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = queries.select("q", F.col("v").alias("u"), F.col("w").alias("w"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return dealt.groupBy("w", "p", "b").cogroup(asked.groupBy("w", "p", "b")).applyInArrow(_comparer(k, places, distance), f"g {kind(rows, 'g')}, q {kind(queries, 'q')}, id {kind(rows, 'id')}, score double")


def _shared_comparer(k: int, places: int, spent: list | None = None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """What a task of ``best_shared_products`` runs; ``spent`` gets the number of products of two weights that each tile takes."""

    class Vectors:
        """Rows of (at, weight), none of them empty, one behind the other."""

        def __init__(self, ends: np.ndarray, at: np.ndarray, weight: np.ndarray):
            self.n, self.ends, self.at, self.weight = len(ends) - 1, ends, at, weight
            self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))

        def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(sizes, places) of the rows' weights."""
            sizes = np.diff(self.ends)[rows]
            return sizes, np.arange(sizes.sum()) + np.repeat(self.ends[rows] - (np.cumsum(sizes) - sizes), sizes)

        def taken(self, rows: np.ndarray) -> Vectors:
            sizes, own = self.entries(rows)
            return Vectors(np.r_[0, np.cumsum(sizes)], self.at[own], self.weight[own])

        def across(self, a: int, b: int, width: int, kind: type = np.float64) -> np.ndarray:
            """A column for each row from a to b."""
            own, out = slice(self.ends[a], self.ends[b]), np.zeros((width, b - a), kind)
            out[self.at[own], self.row[own] - a] = self.weight[own]
            return out

        def nearest(self, centres: np.ndarray) -> np.ndarray:
            return np.concatenate([(centres @ self.across(a, min(a + PLACE_ROWS, self.n), centres.shape[1])).argmax(axis=0) for a in range(0, self.n, PLACE_ROWS)])

    def fitted(some: np.ndarray) -> np.ndarray:
        """Centres of directions, the first ones far from each other."""
        centres = some[:1]
        near = some @ centres[0]
        for _ in range(PLACES - 1):
            centres = np.vstack([centres, some[near.argmin()]])
            near = np.maximum(near, some @ centres[-1])
        for _ in range(5):
            own = (some @ centres.T).argmax(axis=1)
            sums = np.array([some[own == i].sum(axis=0) for i in range(PLACES)])
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
        return centres

    def tiles(of: Vectors, own: np.ndarray, rare: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the rows and (centre, from, to): rows of one centre, those with the same number of strays together."""
        order = np.lexsort((np.bincount(of.row, rare[own[of.row], of.at], of.n), own))
        cuts = np.searchsorted(own[order], np.arange(PLACES + 1)).tolist()
        return order, [(i, x, min(x + most, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for x in range(a, b, most)]

    def true(mask: np.ndarray) -> np.ndarray:
        """Places of the few true values of a flat array."""
        flat = mask.reshape(-1)
        if flat.size % 8:
            return np.flatnonzero(flat)
        words = np.flatnonzero(flat.view(np.uint64))
        word, byte = np.nonzero(flat.reshape(-1, 8)[words])
        return words[word] * 8 + byte

    def k_best(asked: Vectors, rows: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, value): of each query the k rows of largest value over 0, rounded; ties go to the earlier row."""
        width = int(max(asked.at.max(initial=-1), rows.at.max(initial=-1))) + 1
        some = rows.taken(np.unique(np.linspace(0, rows.n - 1, PLACE_ROWS).astype(np.int64)))
        centres = fitted(some.across(0, some.n, width).T)
        near, near_q, alike = rows.nearest(centres), asked.nearest(centres), centres @ centres.T
        used = np.bincount(near[rows.row] * width + rows.at, minlength=PLACES * width).reshape(PLACES, width)
        rare = used < STRAY * np.bincount(near, minlength=PLACES)[:, None]
        (order, parts), (order_q, blocks) = tiles(rows, near, rare, TILE_ROWS), tiles(asked, near_q, rare, BLOCK_QUERIES)
        rows, asked = rows.taken(order), asked.taken(order_q)
        has = np.array([np.bincount(rows.at[rows.ends[x] : rows.ends[y]], minlength=width) > 0 for _, x, y in parts])
        squared, first = rows.weight**2, [x for _, x, _ in parts]
        length = np.sqrt(np.add.reduceat(squared, rows.ends[:-1]).max())
        found = []
        for i, from_, to in blocks:
            across = asked.across(from_, to, width)
            q, terms, squares = np.ascontiguousarray(across.T), (across != 0).any(axis=1), (across * across).T
            across = across.astype(np.float32)
            # what 32 bits and rounding may hide
            slack = (width + 4) * 2.0**-24 * np.sqrt(squares.sum(axis=1)) * length + 1e-30
            best, place = np.full((to - from_, k), -np.inf), np.full((to - from_, k), rows.n)
            # of what both have, no product is larger than the lengths allow
            most = np.maximum.reduceat(np.add.reduceat(np.where(terms[rows.at], squared, 0), rows.ends[:-1]), first)
            shares = np.sqrt(squares @ has.T.astype(float)) * np.sqrt(most)
            for j in np.argsort([-alike[i, c] for c, *_ in parts], kind="stable").tolist():
                least = best[:, -1] - 10.0**-places
                open_ = np.flatnonzero((shares[:, j] > 0) & (shares[:, j] + slack >= least))
                if not len(open_):
                    continue
                _, x, y = parts[j]
                both = np.flatnonzero(terms & has[j])
                s = (across[both] if len(open_) == len(q) else across[np.ix_(both, open_)]).T @ rows.across(x, y, width, np.float32)[both]
                if spent is not None:
                    spent.append(s.size * len(both))
                edge, new = (least - slack)[open_], np.isneginf(best[open_, -1])
                if new.any() and s.shape[1] > k:
                    edge[new] = np.partition(s[new], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 10.0**-places - 2 * slack[open_][new]
                # in 32 bits, a number above its edge is not below the edge in 32 bits
                at = true(s >= np.maximum(edge, 1e-30).astype(np.float32)[:, None])
                if not len(at):
                    continue
                a, b = open_[at // s.shape[1]], at % s.shape[1]
                if len(at) > s.size // 64:
                    value = (q[np.ix_(open_, both)] @ rows.across(x, y, width)[both]).reshape(-1)[at]
                else:
                    sizes, entry = rows.entries(b + x)
                    value = np.add.reduceat(q[np.repeat(a, sizes), rows.at[entry]] * rows.weight[entry], np.cumsum(sizes) - sizes)
                positive, value = value > 0, np.round(value, places)
                keep = positive & (value >= best[a, -1])
                a, b, value = a[keep], order[b[keep] + x], value[keep]
                some, own_ = np.unique(a, return_inverse=True)
                whose = np.concatenate([np.repeat(np.arange(len(some)), k), own_])
                value, row = np.concatenate([best[some].reshape(-1), value]), np.concatenate([place[some].reshape(-1), b])
                by = np.lexsort((row, -value, whose))
                whose = whose[by]
                by = by[np.arange(len(by)) - np.searchsorted(whose, np.arange(len(some)))[whose] < k]
                best[some], place[some] = value[by].reshape(-1, k), row[by].reshape(-1, k)
            a, b = np.nonzero(best > -np.inf)
            found.append((order_q[from_ + a], place[a, b], best[a, b]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def vectors(table: pa.Table) -> Vectors:
        held = table.column("at").combine_chunks()
        return Vectors(held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten().to_numpy(), table.column("weight").combine_chunks().flatten().to_numpy())

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([right.column("q").slice(0, 0), left.column("id").slice(0, 0), pa.array([], pa.float64())], ["q", "id", "score"])
        left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending")]))
        own, row, score = k_best(vectors(right), vectors(left))
        return pa.table([right.column("q").take(pa.array(own)), left.column("id").take(pa.array(row)), pa.array(score)], ["q", "id", "score"])

    return compare


def best_shared_products(rows: DataFrame, queries: DataFrame, k: int, places: int) -> DataFrame:
    """(q, id, score): for each query (q, v) at least its k best rows (id, v) by a product over 0, the best of each part.

    Vectors are arrays of (at, weight over 0), the rest is 0; scores are rounded to ``places``, ties go to the smaller id.
    """
    vectors = lambda df, c: df.select(c, F.col("v.at").alias("at"), F.col("v.weight").alias("weight")).filter(F.size("at") > 0)
    rows, queries = vectors(rows, "id"), vectors(queries, "q")
    blocks = -(-queries.count() // SHARED_QUERIES) or 1
    n = rows.count()
    parts = max(1, -(-n // max(1, min(SHARED_ROWS, -(-n // LEAST_PARTS)))))
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return dealt.groupBy("p", "b").cogroup(asked.groupBy("p", "b")).applyInArrow(_shared_comparer(k, places), f"q {kind(queries, 'q')}, id {kind(rows, 'id')}, score double")
