"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one point of the index; a point keeps the ids of its smallest
``top + 1`` rows, since no other row of it can be among anyone's ``top``. Points are
dealt to shards by length and hash. A shard's graph is a few arrays: levels, one flat
neighbour array for each layer (-1 for none) and the vectors. Every query searches every
shard of vectors of its length and the shards' results are merged by score and id.

Nearness is the largest inner product; graphs are walked by it in single precision,
which serves vectors of about equal length well. Scores are computed in double precision
from the vectors as they are given.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of different length have no
inner product, so each length is searched by itself; ties go to the smaller id; a query
finds itself never, but finds rows that repeat its vector; of rows that repeat an id the
one with the least vector counts; fewer candidates than ``top`` give them all; an empty
table gives an empty table; extra columns are not read.

Scale: a group of the search is one shard (at most about 2 x ``SHARD_ROWS`` points)
and one block of at most about ``BLOCK_ROWS`` queries, so its memory is bounded and
its number is shards x blocks: with a fixed share of the rows as queries, work and what
is shuffled (a shard goes once to each block, a block once to each shard) grow with the
square of the rows, by a factor that larger shards and blocks make smaller.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

TOP = 20
SHARD_ROWS, BLOCK_ROWS = 8192, 16384
#: Neighbours in upper layers (twice as many in the lowest), and beam widths.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 80, 128
BATCH = 256


def _single(given: np.ndarray, each: bool = False) -> np.ndarray:
    """In single precision, after division by a power of two of the largest component (of each row, or of all): the walk
    compares products only, which overflow or vanish without it. Rows are left out of a walk's best ones for nothing but
    being 2 ** 126 times smaller than the largest of their shard."""
    size = np.abs(given).max(axis=1 if each else None, keepdims=True, initial=0)
    return np.ldexp(given.astype(np.float64), -np.frexp(size.astype(np.float64))[1]).astype(np.float32)


class Graph:
    """A navigable small-world graph over rows of x, built and searched for batches of points."""

    def __init__(self, given: np.ndarray, x: np.ndarray, levels: np.ndarray, layers: list[np.ndarray], entry: int):
        self.given, self.x, self.levels, self.layers, self.entry = given, x, levels, layers, entry

    @classmethod
    def build(cls, given: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 11) -> Graph:
        x = _single(given)
        rng, n = np.random.default_rng(seed), len(x)
        levels = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(np.int64), 6)
        order = np.argsort(-levels, kind="stable")  # upper layers first: a point's layers exist when it comes
        x, levels = x[order], levels[order]
        layers = [np.full((n, 2 * links if k == 0 else links), -1, dtype=np.int32) for k in range(int(levels[0]) + 1)] if n else []
        graph = cls(given, x, levels, layers, 0)
        graph.order = order
        done = 1
        while done < n:
            last = min(n, done + max(1, min(BATCH, done)))
            graph._insert(np.arange(done, last), beam)
            done = last
        return graph

    def _insert(self, new: np.ndarray, beam: int) -> None:
        at = np.zeros((len(new), 1), dtype=np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            on = self.levels[new] >= k
            width = beam if on.any() else 1
            found, scores = self._beam(self.x[new], at, k, width)
            if on.any():
                # points of the batch see each other too
                mine, theirs = new[on], new
                near = self.x[mine] @ self.x[theirs].T
                near[(theirs[None, :] == mine[:, None]) | (self.levels[theirs] < k)[None, :]] = -np.inf
                some = np.argsort(-near, axis=1, kind="stable")[:, : self.layers[k].shape[1]]
                cand = np.concatenate([found[on], np.where(np.isfinite(np.take_along_axis(near, some, 1)), theirs[some], -1)], axis=1)
                self._link(mine, cand, k)
            at = found
        del at

    def _link(self, mine: np.ndarray, cand: np.ndarray, k: int) -> None:
        table = self.layers[k]
        for i, c in zip(mine.tolist(), cand):
            c = np.unique(c[c >= 0])
            table[i] = self._chosen(i, c, table.shape[1])
            for j in table[i]:
                if j < 0:
                    break
                free = np.flatnonzero(table[j] < 0)
                if len(free):
                    if i not in table[j]:
                        table[j, free[0]] = i
                elif i not in table[j]:
                    table[j] = self._chosen(int(j), np.append(table[j], i), table.shape[1])

    def _chosen(self, i: int, c: np.ndarray, most: int) -> np.ndarray:
        """Neighbours of i among c: the nearest that are nearer to i than to one already chosen, then the nearest others."""
        out = np.full(most, -1, dtype=np.int32)
        c = c[c != i]
        s = self.x[c] @ self.x[i]
        c = c[np.argsort(-s, kind="stable")[: 2 * most]]
        s = self.x[c] @ self.x[i]
        if len(c) <= most:
            out[: len(c)] = c
            return out
        between = self.x[c] @ self.x[c].T
        picked: list[int] = []
        worst = np.full(len(c), -np.inf)
        for a in range(len(c)):
            if s[a] > worst[a]:
                picked.append(a)
                worst = np.maximum(worst, between[a])
                if len(picked) == most:
                    break
        taken = set(picked)
        picked += [a for a in range(len(c)) if a not in taken][: most - len(picked)]
        out[: len(picked)] = c[picked]
        return out

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` points found from the starts for each query in layer k, best first; -1 where there are fewer."""
        table, n = self.layers[k], len(q)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.x) + 1), dtype=bool)  # the last column stands for no point
        seen[:, -1] = True
        ids = np.where(start >= 0, start, len(self.x))
        fresh = ~seen[rows, ids]
        seen[rows, ids] = True
        ids = np.where(fresh, ids, -1)
        scores = np.where(ids >= 0, np.einsum("nd,nkd->nk", q, self.x[ids]), -np.inf)
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :width]
        ids, scores = np.take_along_axis(ids, keep, 1), np.take_along_axis(scores, keep, 1)
        open_ = np.isfinite(scores)
        live = np.arange(n)
        while len(live):
            best = np.where(open_[live], scores[live], -np.inf)
            pick = best.argmax(axis=1)
            has = np.isfinite(best[np.arange(len(live)), pick])
            live, pick = live[has], pick[has]
            if not len(live):
                break
            open_[live, pick] = False
            around = table[ids[live, pick]]
            around = np.where(around >= 0, around, len(self.x))
            r = live[:, None]
            fresh = ~seen[r, around]
            seen[r, around] = True
            s = np.where(fresh, np.einsum("nd,nkd->nk", q[live], self.x[np.where(fresh, around, 0)]), -np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1)
            all_scores = np.concatenate([scores[live], s], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            keep = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
            if ids.shape[1] < keep.shape[1]:
                more = keep.shape[1] - ids.shape[1]
                ids = np.concatenate([ids, np.full((n, more), -1, dtype=ids.dtype)], axis=1)
                scores = np.concatenate([scores, np.full((n, more), -np.inf)], axis=1)
                open_ = np.concatenate([open_, np.zeros((n, more), dtype=bool)], axis=1)
            ids[live], scores[live], open_[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_scores, keep, 1), np.take_along_axis(all_open, keep, 1)
        return np.where(np.isfinite(scores), ids, -1), scores

    def search(self, q: np.ndarray, top: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Places in the order of build()'s rows of the ``top`` best points for each query; -1 where there are fewer."""
        out = []
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            at = np.full((len(part), 1), self.entry, dtype=np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                at = self._beam(part, at, k, 4)[0]
            found = self._beam(part, at, 0, max(beam, top))[0][:, :top]
            out.append(np.pad(found, ((0, 0), (0, top - found.shape[1])), constant_values=-1))
        return np.concatenate(out) if out else np.empty((0, top), dtype=np.int64)

    def arrays(self) -> dict[str, bytes]:
        return {"levels": self.levels.astype("<i1").tobytes(), "layers": b"".join(t.astype("<i4").tobytes() for t in self.layers), "vectors": self.given[self.order].tobytes()}

    @classmethod
    def of(cls, levels: bytes, layers: bytes, vectors: bytes, kind: str, links: int = LINKS) -> Graph:
        lv = np.frombuffer(levels, "<i1").astype(np.int64)
        n = len(lv)
        given, flat = np.frombuffer(vectors, kind).reshape(n, -1), np.frombuffer(layers, "<i4")
        tables, at = [], 0
        while at < len(flat):
            w = 2 * links if not tables else links
            tables.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(given, _single(given), lv, tables, 0)


def points(rows: DataFrame, key: str, vector: str, top: int) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors: _h (a hash), d (length), vector, ids (the smallest top + 1); and the usable rows: id, _h, d, vector."""
    v = F.col(f"`{vector}`")
    kind = "float" if rows.schema[vector].dataType.elementType.typeName() == "float" else "double"
    v = v.cast(f"array<{kind}>")
    fine = v.isNotNull() & F.col(f"`{key}`").isNotNull() & (F.size(v) > 0)
    fine = fine & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    usable = rows.where(fine).select(F.col(f"`{key}`").cast("long").alias("id"), plain.alias("vector"))
    usable = usable.groupBy("id").agg(F.min("vector").alias("vector")).withColumns({"_h": F.xxhash64("vector"), "d": F.size("vector")})
    dealt = usable.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    # the smallest ids of a vector, first within parts of it: a vector may be a third of all rows
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "vector", "_part").orderBy("id"))).where(F.col("_r") <= top + 1)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "vector").orderBy("id"))).where(F.col("_r") <= top + 1)
    return some.groupBy("_h", "d", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), usable


def _spread(df: DataFrame, groups: int, *by: str) -> DataFrame:
    """Groups over about as many tasks: their rows are few bytes for the seconds that they take, so that adaptive execution
    would put all of them into one task."""
    return df.repartition(max(1, min(4 * groups, 10_000)), *by)


def index(pts: DataFrame, shards: int) -> DataFrame:
    """One row a shard of pts, which has columns d, shard: its graph's arrays, and the ids of its points in the graph's order.

    ``shards`` is how many there are, over which tasks are spread.
    """
    kind = _kind(pts)

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[i[0] for i in pdf["ids"]]).sort_values("first", kind="stable")
        g = Graph.build(np.stack(pdf["vector"].to_numpy()).astype(kind))
        ids = pdf["ids"].to_numpy()[g.order]
        counts = np.array([len(i) for i in ids], dtype="<i4")
        return pd.DataFrame([{"d": int(key[0]), "shard": int(key[1]), "n": len(ids), **g.arrays(), "counts": counts.tobytes(), "ids": np.concatenate(ids).astype("<i8").tobytes()}])

    return _spread(pts, shards, "d", "shard").groupBy("d", "shard").applyInPandas(build, "d int, shard int, n long, levels binary, layers binary, vectors binary, counts binary, ids binary")


def _kind(df: DataFrame) -> str:
    return "<f4" if df.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest rows; queries are rows with the same columns, found among rows by id."""
    spark = rows.sparkSession
    ship(spark)
    pts, _ = points(rows, key, vector, top)
    pts = stored(pts, "points")
    asked_pts, asked = points(queries, key, vector, top)
    # a query's vector is searched once, whoever asks
    asked_vectors = stored(asked_pts.select("_h", "d", "vector"), "asked")
    parts = lambda df, size, name: df.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    shards, blocks = parts(pts, shard_rows, "shards"), parts(asked_vectors, block_rows, "blocks")
    deal = lambda n, seed: F.pmod(F.xxhash64("_h", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    counted = shards.join(blocks, "d", "left").agg(F.sum("shards").alias("shards"), F.sum(F.col("shards") * F.col("blocks")).alias("pairs")).first()
    graphs = stored(index(pts.join(shards, "d").withColumn("shard", deal("shards", 5)).drop("shards"), counted["shards"] or 0), "graphs")
    left = graphs.join(blocks, "d").withColumn("block", every("blocks")).drop("blocks")
    right = asked_vectors.join(blocks, "d").join(shards, "d").withColumn("block", deal("blocks", 7)).withColumn("shard", every("shards")).drop("blocks", "shards")
    kinds = _kind(pts), _kind(asked_vectors)

    def run(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_h": pd.Series(dtype="int64"), "vector": pd.Series(dtype=object), "found": pd.Series(dtype=object)})
        if not len(g) or not len(q):
            return none
        r = g.iloc[0]
        graph = Graph.of(r["levels"], r["layers"], r["vectors"], kinds[0])
        x = np.stack(q["vector"].to_numpy()).astype(kinds[1])
        found = graph.search(_single(x, each=True), min(top + 1, int(r["n"])), beam)
        counts = np.frombuffer(r["counts"], "<i4")
        ids, ends = np.frombuffer(r["ids"], "<i8"), np.cumsum(counts)
        out = []
        for a, places in enumerate(found):
            places = places[places >= 0]
            scores = (graph.given[places].astype(np.float64) * x[a].astype(np.float64)).sum(axis=1).tolist()
            best = sorted((0.0 - s, int(i)) for s, p in zip(scores, places.tolist()) for i in ids[ends[p] - counts[p] : ends[p]])
            out.append([{"minus": s, "vec_id": i} for s, i in best[: top + 1]])
        return pd.DataFrame({"_h": q["_h"].to_numpy(), "vector": q["vector"].to_numpy(), "found": out})

    schema = f"_h long, vector {asked_vectors.schema['vector'].dataType.simpleString()}, found array<struct<minus:double,vec_id:long>>"
    by = "d", "shard", "block"
    spread = lambda df: _spread(df, counted["pairs"] or 0, *by).groupBy(*by)
    each = spread(left).cogroup(spread(right)).applyInPandas(run, schema)
    # one row a shard for a query vector, of at most top + 1 entries
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top + 1)
    merged = each.groupBy("_h", "vector").agg(F.transform(best, lambda f: F.struct((F.lit(0.0) - f["minus"]).alias("score"), f["vec_id"].alias("vec_id"))).alias("found"))
    ends = asked.select(F.col("id").alias("query_id"), "_h", "vector").join(stored(merged, "merged"), ["_h", "vector"])
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top)
    one = ends.select("query_id", F.posexplode(others).alias("rank", "f"))
    return one.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
