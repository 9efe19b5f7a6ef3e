"""Embedding near-duplicates over navigable small-world graphs.

Distinct unit vectors are dealt by hash into shards. Each shard holds a
hierarchical navigable small-world graph; every vector queries every shard.
A query's beam is widened while its whole beam is within the threshold, and
all beams are widened until an audit of sampled queries of all shards against
brute force passes. Candidates are verified by cosine in double precision. A link counts
for both its ends, whichever found it: a search task returns its links as
pairs, but only counts for wide vectors, those with so many links in their own
shard that they are compared with every row, and a spanning forest of all. So
a group of near copies never becomes all its pairs.

Graph steps run for many queries at once in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import lean, small_batches, staged
from tidewell.llm.components import components, local_roots

THRESHOLD = 0.95
#: Vectors in a shard at most (expected), links of a node, and beams of building and searching.
SHARD = 50_000
SHARDS = 6
LINKS = 12
BUILD_BEAM = 32
BEAM = 24
#: Beams stay below this width; queries that fill them are compared with the whole shard.
WIDEST = 1_536
#: Links in its own shard from which a vector is wide: compared with all rows of every shard, and counted without pairs.
WIDE = 64
AUDIT_QUERIES = 200
AUDIT_LINKED = 200
AUDIT_RECALL = 0.98
QUERY_BLOCK = 4_096
#: Blocks of queries that a task runs against its shard (expected).
TASK_BLOCKS = 16


class Graph:
    """Layers of neighbour tables over the rows of ``x`` (unit vectors, float32)."""

    def __init__(self, x: np.ndarray, seed: int = 3) -> None:
        self.x = x
        n = len(x)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(LINKS)).astype(int), 4) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # the sparse layers first, so every layer has its entries
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbours by place in members; top first
        for k in range(int(level.max(initial=0)), -1, -1):
            self._grow(order[level[order] >= k], 2 * LINKS if k == 0 else LINKS)

    def _grow(self, members: np.ndarray, width: int) -> None:
        """Add a layer: insert its members in doubling blocks against those already in."""
        n = len(members)
        x = self.x[members]
        near = np.full((n, width), -1)
        gain = np.full((n, width), -np.inf, np.float32)
        done = min(n, 256)
        if done > 1:
            self._connect(x, near, gain, np.arange(done), *_top(x[:done] @ x[:done].T, width, own=np.arange(done)))
        while done < n:
            block = np.arange(done, min(n, done + max(256, min(done // 2, 2048))))
            entry = self._entries(x[block], self.layers, done)
            found, sim = _beam(x[:done], near[:done], x[block], entry, max(BUILD_BEAM, width))
            inside = x[block] @ x[block].T
            ids, sims = _top(inside, width, own=np.arange(len(block)))
            every = np.concatenate((found, np.where(ids >= 0, block[0] + ids, -1)), axis=1)
            score = np.concatenate((sim, sims), axis=1)
            pick = np.argsort(-score, axis=1, kind="stable")[:, : 2 * width]
            self._connect(x, near, gain, block, np.take_along_axis(every, pick, 1), np.take_along_axis(score, pick, 1))
            done = int(block[-1]) + 1
        self.layers.append((members, near))

    def _connect(self, x, near, gain, block, ids, sims) -> None:
        """Link each of ``block`` to diverse candidates, and those back."""
        width = near.shape[1]
        ids, sims = _diverse(x, ids, sims, width // 2 or 1, width)
        near[block[:, None], np.arange(ids.shape[1])] = ids
        gain[block[:, None], np.arange(ids.shape[1])] = sims
        a, b, s = np.repeat(block, ids.shape[1]), ids.ravel(), sims.ravel()
        ok = b >= 0
        a, b, s = a[ok], b[ok], s[ok]
        order = np.lexsort((-s, b))
        a, b, s = a[order], b[order], s[order]
        first = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0)) if len(b) else b
        a, b, s, rank = (v[rank < width] for v in (a, b, s, rank))
        touched = np.unique(b)
        if not len(touched):
            return
        place = np.searchsorted(touched, b)
        new, worth = np.full((len(touched), width), -1), np.full((len(touched), width), -np.inf, np.float32)
        new[place, rank], worth[place, rank] = a, s
        every = np.concatenate((near[touched], new), axis=1)
        score = np.concatenate((gain[touched], worth), axis=1)
        # a link both ways may be offered twice
        by = np.argsort(every, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(every, by, 1)
        twice = np.zeros_like(by, bool)
        np.put_along_axis(twice, by[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        score = np.where(twice | (every < 0), -np.inf, score)
        pick = np.argsort(-score, axis=1, kind="stable")
        every, score = np.take_along_axis(every, pick, 1), np.take_along_axis(score, pick, 1)
        every = np.where(np.isneginf(score), -1, every)
        ids, sims = _diverse(x, every, score, width // 2 or 1, width)
        near[touched] = -1
        gain[touched] = -np.inf
        near[touched[:, None], np.arange(ids.shape[1])] = ids
        gain[touched[:, None], np.arange(ids.shape[1])] = sims

    def _entries(self, q: np.ndarray, layers: list, done: int) -> np.ndarray:
        """Where a search of the layer below ``layers`` begins.

        A layer's members are the first of the next one's, in the same order,
        so a place in one is the same place in the other; the first serves
        where the layer below has not come that far yet.
        """
        at = np.zeros((len(q), 1), np.int64)
        for own, near in layers:
            at = _beam(self.x[own], near, q, at, 4)[0][:, :1]
        return np.where(at < done, at, 0)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        members, near = self.layers[-1]
        entry = self._entries(q, self.layers[:-1], len(members))
        ids, sims = _beam(self.x[members], near, q, entry, beam)
        return np.where(ids >= 0, members[ids], -1), sims


def _top(sims: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sims = sims.copy()
    sims[np.arange(len(own)), own] = -np.inf
    k = min(k, sims.shape[1])
    ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(sims, ids, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
    return np.where(np.isneginf(best), -1, ids), best


def _diverse(x, ids, sims, sure: int, width: int):
    """Of candidates in falling order: those nearer to the node than to one chosen before, then the best rest."""
    n, m = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.einsum("nid,njd->nij", v, v)
    chosen = np.zeros((n, m), bool)
    for j in range(m):
        shadow = (chosen[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(axis=1) if j else np.zeros(n, bool)
        chosen[:, j] = (ids[:, j] >= 0) & ~shadow & (chosen[:, :j].sum(axis=1) < width)
    key = np.where(chosen, 0, 1) + np.where(ids < 0, 2, 0)
    order = np.argsort(key, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.where(np.take_along_axis(ids, order, 1) >= 0, np.take_along_axis(sims, order, 1), -np.inf)


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all queries at once: ids (-1 where fewer) and cosines, falling."""
    out_i, out_s = np.full((len(q), beam), -1), np.full((len(q), beam), -np.inf, np.float32)
    for a in range(0, len(q), 512):
        out_i[a : a + 512], out_s[a : a + 512] = _beam_block(x, near, q[a : a + 512], entry[a : a + 512], beam)
    return out_i, out_s


def _beam_block(x, near, q, entry, beam):
    n, rows = len(q), np.arange(len(q))[:, None]
    ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column is for missing neighbours
    seen[:, -1] = True
    first = entry[:, :beam]
    ids[:, : first.shape[1]] = first
    sims[:, : first.shape[1]] = np.einsum("nkd,nd->nk", x[first], q)
    open_[:, : first.shape[1]] = True
    seen[rows, first] = True
    live = np.arange(n)
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
        go = open_[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        open_[live, best] = False
        fresh = near[ids[live, best]]
        old = seen[live[:, None], fresh]
        seen[live[:, None], fresh] = True
        s = np.einsum("nkd,nd->nk", x[np.maximum(fresh, 0)], q[live])
        s[old] = -np.inf
        every_s = np.concatenate((sims[live], s), axis=1)
        order = np.argsort(-every_s, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(every_s, order, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], fresh), axis=1), order, 1)
        open_[live] = np.take_along_axis(np.concatenate((open_[live], ~old), axis=1), order, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, ids), sims


def pairs_within(graph: Graph, exact: np.ndarray, q: np.ndarray, threshold: float, beam: int, wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs found with cosine >= threshold, verified in double precision, in bounded parts.

    ``q`` and ``exact`` (the graph's rows) are float64 unit vectors. A query
    whose beam ends inside the threshold searches again with one four times
    as wide; where that would be ``WIDEST`` or more it is compared with all
    rows, as those marked in ``wide`` are at once. Marks are set for the
    queries that were compared with all rows. No pair comes twice.
    """
    wide = np.zeros(len(q), bool) if wide is None else wide
    todo, slack = np.flatnonzero(~wide), threshold - 1e-4  # float32 search, double verification
    while len(todo) and beam < min(WIDEST, len(exact)):
        full = np.zeros(len(todo), bool)
        for i in range(0, len(todo), 512):
            part = todo[i : i + 512]
            ids, sims = graph.search(q[part].astype(np.float32), beam)
            full[i : i + 512] = sims[:, -1] >= slack
            rows, cols = np.nonzero((sims >= slack) & (ids >= 0) & ~full[i : i + 512, None])
            a, b = part[rows], ids[rows, cols]
            ok = np.einsum("nd,nd->n", q[a], exact[b]) >= threshold
            yield a[ok], b[ok]
        todo, beam = todo[full], beam * 4
    wide[todo] = True
    todo = np.flatnonzero(wide)
    for i in range(0, len(todo), 256):
        for j in range(0, len(exact), 4096):
            rows, cols = np.nonzero(q[todo[i : i + 256]] @ exact[j : j + 4096].T >= slack)
            a, b = todo[i + rows], j + cols
            ok = np.einsum("nd,nd->n", q[a], exact[b]) >= threshold
            yield a[ok], b[ok]


def audited_beam(graph: Graph, exact: np.ndarray, threshold: float, beam: int = BEAM, q: np.ndarray | None = None, own: np.ndarray | None = None) -> int:
    """Widen the beam until sampled queries' links come back; brute force on the sample is the measure.

    ``own`` has each query's place among the rows, -1 where it is none; a
    query's match with itself is no link. The sample doubles until
    ``AUDIT_LINKED`` of its queries have a link or all are in it. The recall
    is the mean over the queries that have a link. Without ``q`` the rows
    themselves are the queries.
    """
    if q is None:
        q, own = exact, np.arange(len(exact))
    order = np.random.default_rng(5).permutation(len(q))
    x, truth, done = exact.astype(np.float32), np.zeros(len(q), np.int64), 0
    while done < len(q) and np.count_nonzero(truth) < AUDIT_LINKED:
        more = max(AUDIT_QUERIES, done)
        for i in range(done, min(len(q), done + more), 256):
            part = order[i : min(i + 256, done + more)]
            rows, cols = np.nonzero(q[part].astype(np.float32) @ x.T >= threshold - 1e-4)
            for j in range(0, len(rows), 65_536):
                a, b = part[rows[j : j + 65_536]], cols[j : j + 65_536]
                ok = (np.einsum("nd,nd->n", q[a], exact[b]) >= threshold) & (own[a] != b)
                np.add.at(truth, a[ok], 1)
        done += more
    linked = np.flatnonzero(truth)
    while len(linked) and beam < len(exact):
        found = np.zeros(len(linked), np.int64)
        for a, b in pairs_within(graph, exact, q[linked], threshold, beam):
            np.add.at(found, a[own[linked[a]] != b], 1)
        if (found / truth[linked]).mean() >= AUDIT_RECALL:
            break
        beam *= 2
    return min(beam, max(1, len(exact)))


def wide_rows(exact: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Marks of the rows with ``least`` links or more among the rows, by comparing all."""
    x = exact.astype(np.float32)
    return np.concatenate([((x[i : i + 1024] @ x.T) >= threshold).sum(axis=1) > least for i in range(0, len(x), 1024)])


def _unit(values) -> np.ndarray:
    v = np.array(values, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a count, so copies are never expanded:
    a row links with all copies of its vector and of the vectors that its own
    queries find or whose queries find it.
    Null, zero and non-finite vectors, and vectors with a null component, link
    with nothing and are their own components. Vectors of different lengths
    are never compared. A null vec_id gets component_id null and is kept.
    Other columns, labels too, are ignored.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    marked = rows.withColumn("ok", F.coalesce(F.expr(usable), F.lit(False)))
    hashed = marked.where("ok").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    nodes = staged(hashed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v")).withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}), table)
    total = nodes.count()
    shards = max(SHARDS, -(-total // SHARD))
    parts = max(1, -(-total // (TASK_BLOCKS * QUERY_BLOCK)))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(r, np.float64).tobytes() for r in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dim"), batch.column("copies"), pa.array(raw, pa.binary())], names=["node", "dim", "copies", "raw"])

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node")
        exact = _unit([np.frombuffer(r) for r in shard["raw"]])
        graph = Graph(exact.astype(np.float32))
        graph.x = None  # made again from the exact rows
        node, copies, wide = shard["node"].to_numpy(), shard["copies"].to_numpy(), wide_rows(exact, threshold, WIDE)
        rows = [(pickle.dumps((graph, node, copies, wide, exact)), None)]
        for i in range(0, len(shard), QUERY_BLOCK):
            part = slice(i, i + QUERY_BLOCK)
            rows.append((None, pickle.dumps((node[part], copies[part], wide[part], exact[part]))))
        return pd.DataFrame({"dim": shard["dim"].iloc[0], "s": shard["s"].iloc[0], "graph": [r[0] for r in rows], "asked": [r[1] for r in rows]})

    def search(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((4, 0), np.int64)]
        for made in shard["graph"]:
            graph, other, copies, wide, exact = pickle.loads(made)
            graph.x = exact.astype(np.float32)
            blocks = [pickle.loads(asked) for asked in queries["asked"]]
            if not blocks:
                continue
            # wide queries meet all rows, so the others are audited, of all shards
            rest = np.concatenate([me[~mine] for me, _, mine, _ in blocks])
            place = np.minimum(np.searchsorted(other, rest), len(other) - 1)
            beam = audited_beam(graph, exact, threshold, BEAM, np.concatenate([q[~mine] for _, _, mine, q in blocks]), np.where(other[place] == rest, place, -1))
            for me, my_copies, mine, q in blocks:
                linked, root = np.zeros(len(me), np.int64), np.arange(len(me) + len(other))
                for a, b in pairs_within(graph, exact, q, threshold, beam, mine.copy()):
                    differ = me[a] != other[b]
                    a, b = a[differ], b[differ]
                    root = local_roots(np.concatenate((a, np.arange(len(root)))), np.concatenate((b + len(me), root)), len(root))
                    counted = mine[a]
                    np.add.at(linked, a[counted], copies[b[counted]])
                    tell = ~(counted & wide[b])
                    a, b = a[tell], b[tell]
                    # what the link adds to each end; nothing to a wide one, which is counted
                    add_a, add_b = np.where(mine[a], 0, copies[b]), np.where(wide[b], 0, my_copies[a])
                    swap = me[a] > other[b]
                    out.append(np.stack([np.where(swap, y, x) for x, y in ((me[a], other[b]), (other[b], me[a]), (add_a, add_b), (add_b, add_a))]))
                both, tied = np.concatenate((me, other)), np.flatnonzero(root != np.arange(len(root)))
                out.append(np.stack((both[tied], both[root[tied]], np.zeros(len(tied), np.int64), np.zeros(len(tied), np.int64))))
                found = np.flatnonzero(linked)
                out.append(np.stack((me[found], me[found], linked[found], np.zeros(len(found), np.int64))))
        u, v, n, m = np.concatenate(out, axis=1)
        return pd.DataFrame({"u": u, "v": v, "n": n, "m": m})

    packed = staged(small_batches(nodes).select("node", "dim", "copies", "v").mapInArrow(lean(flat), "node long, dim int, copies long, raw binary"))
    graphs = staged(packed.withColumn("s", F.expr(f"cast(pmod(xxhash64(node), {shards}) as int)")).groupBy("dim", "s").applyInPandas(build, "dim int, s int, graph binary, asked binary"))
    # every shard meets every block of queries; a task has one shard and about TASK_BLOCKS blocks
    asked = graphs.where("asked is not null").select("dim", "asked").withColumn("t", F.expr(f"cast(pmod(xxhash64(asked), {parts}) as int)")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    place = graphs.where("graph is not null").select("dim", "s", "graph").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = place.groupBy("dim", "s", "t").cogroup(asked.groupBy("dim", "s", "t")).applyInPandas(search, "u long, v long, n long, m long")
    links = staged(found, table)
    counted = links.where("u = v").select(F.col("u").alias("end"), "n")
    pairs = links.where("u <> v and (n > 0 or m > 0)").distinct().select(F.explode(F.array(F.struct(F.col("u").alias("end"), "n"), F.struct(F.col("v").alias("end"), F.col("m").alias("n")))).alias("e")).select("e.*")
    other = counted.unionByName(pairs).groupBy("end").agg(F.sum("n").alias("linked"))
    roots = components(links.where("n = 0 and m = 0").select("u", "v"), table)
    member = nodes.select("k1", "k2", "node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(named, "root").join(other, member["node"] == other["end"], "left").select("k1", "k2", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    joined = hashed.select("vec_id", "k1", "k2").join(of, ["k1", "k2"])
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull())
    good = joined.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", kept)
    alone = marked.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(alone)
