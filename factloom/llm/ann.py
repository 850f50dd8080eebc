"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Vectors are dealt to shards of bounded size by hash; every vector is indexed,
equal ones once with all their ids. In a shard vectors join the graph in
batches: a greedy beam search proposes neighbours, and relaxed distance pruning
keeps an edge only if no kept neighbour is `relax` times closer to its end;
reverse edges are pruned the same way. Each graph is built once and stored; then
all queries stream past it, batch by batch. A query searches every shard by a
beam, and the best of all shards are merged with exact scores.

A shard chooses its own beam: from `beam` on it doubles until searches for some
of the shard's own vectors find the share `TARGET` of what brute force finds.
So vectors without any structure cost more, and are not found less.

Inner products become distances by one more coordinate that gives all vectors
of a shard the same length. Searches of many queries advance together in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.vafile import as_wide, best, indexed, streamed, unique_vectors

DEGREE, BEAM, RELAX = 32, 96, 1.05
#: Recall within a shard at which its beam is wide enough, and vectors by which that is measured.
TARGET, TRIALS = 0.96, 64
#: Vectors of a shard, queries searched together, vectors that join together.
SHARD, ABREAST, JOIN = 16_384, 256, 256


class Graph:
    def __init__(self, x: np.ndarray, degree: int = DEGREE, build_beam: int = BEAM, relax: float = RELAX, seed: int = 5):
        norm = (x * x).sum(1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], 1).astype(np.float32)
        self.norm = (self.x * self.x).sum(1)
        self.degree, self.relax = degree, relax
        self.near = np.full((len(x), degree), -1, np.int64)
        self.entry = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        order = np.random.default_rng(seed).permutation(len(x))
        order = np.r_[self.entry, order[order != self.entry]]
        at = 1
        while at < len(order):
            group = order[at : at + min(JOIN, max(1, at))]
            found = self.search(self.x[group], build_beam)
            self.near[group] = self.prune(group, found)
            self.reverse(group)
            at += len(group)

    @classmethod
    def of(cls, x: np.ndarray, last: np.ndarray, near: np.ndarray, entry: int) -> Graph:
        """The graph as it was built, from its vectors, their last coordinate, its edges and its entry."""
        graph = cls.__new__(cls)
        graph.x = np.concatenate([x.astype(np.float32), last[:, None]], 1)
        graph.norm, graph.near, graph.entry = (graph.x * graph.x).sum(1), near, entry
        return graph

    def distances(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row's point to each of its ids; infinite at -1."""
        y = self.x[ids]
        d = self.norm[ids] - 2 * np.einsum("bcd,bd->bc", y, rows) + (rows * rows).sum(1)[:, None]
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def search(self, rows: np.ndarray, beam: int, abreast: int = 4) -> np.ndarray:
        """Ids of the beam of each row's greedy search, nearest first, -1 where it holds fewer."""
        out = []
        for at in range(0, len(rows), ABREAST):
            part = rows[at : at + ABREAST]
            n = len(part)
            ids = np.full((n, beam), -1, np.int64)
            ids[:, 0] = self.entry
            dist = self.distances(part, ids)
            opened = ids < 0
            seen = np.zeros((n, len(self.x)), bool)
            seen[:, self.entry] = True
            lines = np.arange(n)[:, None]
            while True:
                want = np.argsort(np.where(opened, np.inf, dist), 1, kind="stable")[:, :abreast]
                fresh = ~opened[lines, want]
                go = np.flatnonzero(fresh.any(1))
                if not len(go):
                    break
                opened[lines, want] = True
                step = np.where(fresh[go][:, :, None], self.near[ids[go[:, None], want[go]]], -1).reshape(len(go), -1)
                step = np.where(seen[go[:, None], step] | (step < 0), -1, step)
                step.sort(1)
                step[:, 1:][step[:, 1:] == step[:, :-1]] = -1
                own, col = np.nonzero(step >= 0)
                seen[go[own], step[own, col]] = True
                d = self.distances(part[go], step)
                all_d = np.concatenate([dist[go], d], 1)
                keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
                deep = np.arange(len(go))[:, None]
                ids[go] = np.concatenate([ids[go], step], 1)[deep, keep]
                opened[go] = np.concatenate([opened[go], step < 0], 1)[deep, keep]
                dist[go] = all_d[deep, keep]
            out.append(ids)
        return np.concatenate(out)

    def prune(self, points: np.ndarray, found: np.ndarray) -> np.ndarray:
        """At most `degree` of each point's found ids: nearest first, without those that a kept one is relaxed-nearer to."""
        out = np.full((len(points), self.degree), -1, np.int64)
        for at in range(0, len(points), ABREAST):
            own, ids = points[at : at + ABREAST], found[at : at + ABREAST]
            ids = np.where(ids == own[:, None], -1, ids)
            d = self.distances(self.x[own], ids)
            order = np.argsort(d, 1, kind="stable")
            lines = np.arange(len(own))[:, None]
            ids, d = ids[lines, order], d[lines, order]
            y = self.x[ids]
            between = self.norm[ids][:, :, None] + self.norm[ids][:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            alive, kept = np.isfinite(d), np.zeros(len(own), np.int64)
            relax = self.relax**2
            for c in range(ids.shape[1]):
                take = np.flatnonzero(alive[:, c] & (kept < self.degree))
                if len(take):
                    out[at + take, kept[take]] = ids[take, c]
                    kept[take] += 1
                    alive[take] &= relax * between[take, c] > d[take]
                elif (kept >= self.degree).all():
                    break
        return out

    def reverse(self, group: np.ndarray) -> None:
        """Adds the edges back to a group; a full list is pruned anew with its nearest new ends."""
        ends = self.near[group]
        start = np.repeat(group, ends.shape[1])[ends.ravel() >= 0]
        to = ends.ravel()[ends.ravel() >= 0]
        new = ~(self.near[to] == start[:, None]).any(1)
        start, to = start[new], to[new]
        if not len(to):
            return
        d = ((self.x[start] - self.x[to]) ** 2).sum(1)
        order = np.lexsort((d, to))
        start, to = start[order], to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        inside = rank < self.degree
        nodes = to[first]
        added = np.full((len(nodes), self.degree), -1, np.int64)
        added[np.searchsorted(nodes, to[inside]), rank[inside]] = start[inside]
        both = np.concatenate([self.near[nodes], added], 1)
        few = (both >= 0).sum(1) <= self.degree
        packed = -np.sort(-both[few], 1)[:, : self.degree]
        self.near[nodes[few]] = packed
        if (~few).any():
            self.near[nodes[~few]] = self.prune(nodes[~few], both[~few])


class Index:
    """A stored shard: distinct vectors with the ids of each, their graph, and the beam that it needs."""

    def __init__(self, graph: Graph, distinct: np.ndarray, ids: np.ndarray, cuts: np.ndarray, beam: int):
        self.graph, self.distinct, self.ids, self.cuts, self.beam = graph, distinct, ids, cuts, beam

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, k: int, beam: int = 128, **graph) -> Index:
        order = np.argsort(ids)
        distinct, where = np.unique(x[order], axis=0, return_inverse=True)
        by = np.argsort(where.ravel(), kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(where.ravel(), minlength=len(distinct)))]
        made = cls(Graph(distinct, **graph), distinct, ids[order][by], cuts, beam)
        made.widen(k)
        return made

    def widen(self, k: int) -> None:
        trials = self.distinct[np.random.default_rng(3).permutation(len(self.distinct))[:TRIALS]]
        k = min(k, len(self.distinct))
        score = trials @ self.distinct.T
        kth = -np.partition(-score, k - 1, 1)[:, k - 1 : k]
        while self.beam < len(self.distinct):
            found = self.places(trials, self.beam)
            hits = np.where(found >= 0, np.take_along_axis(score, np.maximum(found, 0), 1), -np.inf) >= kth
            if np.minimum(hits.sum(1), k).mean() >= TARGET * k:
                break
            self.beam *= 2

    def places(self, queries: np.ndarray, beam: int) -> np.ndarray:
        return self.graph.search(np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32), beam)

    def packed(self) -> bytes:
        single = self.distinct.astype(np.float32)
        g = self.graph
        return pickle.dumps((single if (single == self.distinct).all() else self.distinct, self.ids, self.cuts, self.beam, g.x[:, -1], g.near.astype(np.int32), g.entry))

    @classmethod
    def unpacked(cls, raw: bytes) -> Index:
        distinct, ids, cuts, beam, last, near, entry = pickle.loads(raw)
        return cls(Graph.of(distinct, last, near, entry), distinct.astype(np.float64), ids, cuts, beam)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """query id, ids and exact scores of the shard's best for each query, at most k a query."""
        queries = as_wide(queries, self.distinct.shape[1])
        for own, q, places in zip(query_ids.tolist(), queries, self.places(queries, max(self.beam, k + 1)), strict=True):
            places = places[places >= 0]
            score = self.distinct[places] @ q
            lists = [self.ids[self.cuts[p] : min(self.cuts[p + 1], self.cuts[p] + k + 1)] for p in places]  # the k smallest ids of equal vectors suffice
            flat, scores = np.concatenate(lists), np.repeat(score, [len(i) for i in lists])
            other = flat != own
            flat, scores = flat[other], scores[other]
            first = np.lexsort((flat, -scores))[:k]
            yield own, flat[first], scores[first]


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, beam: int = 128, per_shard: int = SHARD, degree: int = DEGREE, build_beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score double: k nearest found for each row of queries in table (vec_id, embedding each).

    The score is the inner product of the original vectors in double precision. Ties go to the smaller vec_id; a
    query's own vec_id is no candidate. Null, empty and zero vectors and those with null or non-finite components
    take no part, nor do rows without vec_id; equal vec_ids are one row. Of vectors of different lengths, the
    shorter counts as filled up with zeros. Other columns are not read; empty tables give an empty result.
    """
    usable = lambda t: unique_vectors(t).where(F.exists("vector", lambda v: v != 0))
    build = lambda ids, x: Index.build(ids, x, k + 1, beam, degree=degree, build_beam=build_beam, relax=relax).packed()
    indexes, shards = indexed(usable(table), per_shard, build)

    def search(raw: bytes) -> Callable:
        index = Index.unpacked(raw)
        return lambda ids, y: index.search(ids, y, k)

    return best(streamed(indexes, shards, usable(queries), search, "double"), k)
