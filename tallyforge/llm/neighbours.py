"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node. A node carries a code of its vector: two bytes for each of its
components over its own largest one. The vector has one more component that
brings all vectors to one length, so that the graph's nearness is a metric for
vectors of any lengths; a query has none there, which leaves the inner product.

The graph begins with trees of random hyperplanes that are fitted on a bounded
sample: each sorts all nodes into an order, and runs of CHUNK nodes of it are
compared with each other. Then NN-descent: the codes of a node's neighbours, of
those it has and of some that have it, are joined to it, all of these are
compared with each other, and every node keeps the best of what it met. Rounds
go on until few entries change.

A query begins at its own node. Each hop opens its best unopened nodes, joined
to their neighbours' codes in a table that is bucketed by node, and keeps the best it
has seen, until the nearest of few queries change. Codes choose what is nearest; the vectors themselves then give exact
products and ranks.

Bounds: trees are fitted on SAMPLE nodes; a node keeps DEGREE neighbours, and of
nodes that have it the BACK nearest join its comparisons. These shape the graph;
no row is left out of it, and recall is measured in the tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id and vectors shorter than the
longest; of several vectors of one id the least counts; of equal vectors those
of the least ids come first; if there are fewer candidates than asked for, all
come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks

NEAREST, QUERY_STEP = 20, 20
SAMPLE, TREES, DEPTH, CHUNK, FROM_CHUNK = 8192, 8, 9, 1024, 24
DEGREE, BACK = 48, 32
#: Rows that a Python worker gets at a time.
BATCH = 1024
#: Neighbourhoods whose finds are merged before they are passed on: few, so that what is passed on grows in step with the nodes.
JOINED = 64
#: Rounds of NN-descent end when a smaller share of entries changes, or after so many.
LEAST_CHANGE, MOST_ROUNDS = 0.25, 8
#: Nodes that a query opens in each hop after its own, the last number in all further ones; hops end when the nearest of a smaller share of queries change.
HOPS, LEAST_BETTER, MOST_HOPS = (1, 20, 40, 80), 0.2, 12
#: What a query keeps meanwhile, and what of it goes to the exact products.
BEAM, EXACT = 192, 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one finite vector, other than zero, of each id."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda x: F.coalesce((x > -math.inf) & (x < math.inf), F.lit(False)))
    rows = vectors.where("vec_id is not null").where(F.size("embedding") > 0).where(finite & F.exists(c, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda x: x + 0.0).alias("v"))


def nodes_of(rows: DataFrame, nearest: int) -> DataFrame:
    """(node, v, ids): distinct vectors under their least id, with the ids that can be among the nearest, in order."""
    least = rows.select("*", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")).alias("k")).where(F.col("k") <= nearest + 1)
    return least.groupBy("v").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("node", "v", "ids")


def encode(v: np.ndarray) -> pa.Array:
    """Codes of vectors: two bytes for each component, and the factor of all as the last four."""
    factor = np.maximum(np.abs(v).max(1), 1e-30) / 32767
    coded = np.concatenate([np.rint(v / factor[:, None]).astype("<i2").view(np.uint8), factor.astype("<f4")[:, None].view(np.uint8)], axis=1)
    offsets = np.arange(len(v) + 1, dtype=np.int32) * coded.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(coded))])


def decode(codes: pa.Array) -> np.ndarray:
    if not len(codes):
        return np.zeros((0, 1), np.float32)
    _, offsets, data = codes.buffers()
    offsets = np.frombuffer(offsets, np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(codes), -1)
    return np.ascontiguousarray(raw[:, :-4]).view("<i2").astype(np.float32) * np.ascontiguousarray(raw[:, -4:]).view("<f4")


def _coder(largest: float, longest: float):
    """A function from rows (node, v) to (node, code, query); `largest` is the largest component, `longest` the greatest length over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) / largest / longest
                more = np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), encode(np.hstack([v, more])), encode(np.hstack([v, 0 * more]))], ["node", "code", "query"])

    return run


def tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(normals, limits) of a complete tree: a node's plane lies between two of its rows and halves them."""
    normals, limits = np.zeros((1 << depth, sample.shape[1]), np.float32), np.zeros(1 << depth, np.float32)
    at = np.ones(len(sample), np.int64)
    for level in range(depth):
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                normals[at[rows[0]]] = sample[a] - sample[b]
                limits[at[rows[0]]] = np.median(sample[rows] @ normals[at[rows[0]]])
        at = 2 * at + ((sample * normals[at]).sum(1) > limits[at])
    return normals, limits


def _router(trees: list[tuple[np.ndarray, np.ndarray]], aside: np.ndarray, depth: int):
    """A function from rows (node, code) to (tree, leaf, side, node, code): a node's leaf in every tree, and its place aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = decode(batch.column(1))
            for k, (normals, limits) in enumerate(trees):
                at = np.ones(len(v), np.int64)
                for _ in range(depth):
                    at = 2 * at + ((v * normals[at]).sum(1) > limits[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(at), pa.array((v @ aside[k]).astype(np.float64)), batch.column(0), batch.column(1)], ["tree", "leaf", "side", "node", "code"])

    return run


def _lists(group: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """List arrays of `n` rows from values ordered by their row."""
    offsets = pa.array(np.searchsorted(group, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _found(node: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows (node, ids, scores) with the best `most` distinct of what each node met."""
    order = np.lexsort((-score, near, node))
    node, near, score = node[order], near[order], score[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    node, near, score = node[new], near[new], score[new]
    order = np.lexsort((near, -score, node))
    node, near, score = node[order], near[order], score[order]
    names, first = np.unique(node, return_index=True)
    keep = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node)))) < most
    group = np.searchsorted(names, node[keep])
    return pa.RecordBatch.from_arrays([pa.array(names), *_lists(group, len(names), near[keep], score[keep].astype(np.float32))], ["node", "ids", "scores"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            v, node, which = decode(part.column(4)), part.column(3).to_numpy(), part.column(0).to_numpy()
            score = v @ v.T
            score[(node[:, None] == node) | (which[:, None] != which)] = -np.inf
            most = min(FROM_CHUNK, len(v) - 1)
            if most < 1:
                continue
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(score, best, 1).ravel()
            has = value > -np.inf
            yield _found(np.repeat(node, most)[has], node[best.ravel()][has], value[has], most)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a node's neighbours (id, code, worst score kept) to what these met in each other."""
    for batch in batches:
        for at in range(0, batch.num_rows, JOINED):
            lists = batch.column(0).slice(at, JOINED)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            member, worst, v = flat.field("member").to_numpy(zero_copy_only=False), flat.field("worst").to_numpy(zero_copy_only=False), decode(flat.field("code"))
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            width = int(size.max(initial=0))
            names, limit, dense = np.full((len(size), width), -1, np.int64), np.full((len(size), width), np.inf, np.float32), np.zeros((len(size), width, v.shape[1]), np.float32)
            names[row, place], limit[row, place], dense[row, place] = member, worst, v
            score = dense @ dense.transpose(0, 2, 1)
            step = np.arange(width)
            score[:, step, step] = -np.inf
            score.transpose(1, 0, 2)[:, ~(size[:, None] > step)] = -np.inf
            w, a, b = np.nonzero(score > limit[:, :, None])
            if len(w):
                yield _found(names[w, a], names[w, b], score[w, a, b], DEGREE)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, what it met as a list of lists (ids, scores, old)) to (node, ids, scores, changed)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            outer = part.column(1)
            inner = outer.flatten()
            each = np.repeat(np.arange(part.num_rows), np.diff(outer.offsets.to_numpy()))
            size = np.diff(inner.field("ids").offsets.to_numpy())
            row, old = np.repeat(each, size), np.repeat(inner.field("old").to_numpy(zero_copy_only=False), size)
            near, score = inner.field("ids").flatten().to_numpy(), inner.field("scores").flatten().to_numpy()
            order = np.lexsort((~old, near, row))  # an entry that was there stays as it was
            row, near, score, old = row[order], near[order], score[order], old[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
            row, near, score, old = row[new], near[new], score[new], old[new]
            order = np.lexsort((near, -score, row))
            row, near, score, old = row[order], near[order], score[order], old[order]
            first = np.searchsorted(row, np.arange(part.num_rows))
            keep = np.arange(len(row)) - first[row] < DEGREE
            row, near, score, old = row[keep], near[keep], score[keep], old[keep]
            changed = np.bincount(row[~old], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), *_lists(row, part.num_rows, near, score), pa.array(changed.astype(np.int32))], ["node", "ids", "scores", "changed"])


_GRAPH = "node long, ids array<long>, scores array<float>"


def _gathered(found: DataFrame) -> DataFrame:
    """One row of each node, with the best of all it met."""
    lists = found.groupBy("node").agg(F.collect_list(F.struct("ids", "scores", "old")).alias("met"))
    return lists.mapInArrow(_merged, f"{_GRAPH}, changed int")


def _around(graph: DataFrame, codes: DataFrame, worst: bool) -> DataFrame:
    """(node, member, code, worst): the neighbours of each node, and the nearest of those that have it as one."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.scores").alias("score"))
    back = edges.select("*", F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "node")).alias("k")).where(F.col("k") <= BACK)
    back = back.groupBy("other").agg(F.collect_list("node").alias("back")).withColumnRenamed("other", "node")
    every = graph.select("node", "ids").join(back, "node", "left").select("node", F.explode(F.array_union("ids", F.coalesce("back", F.array().cast("array<long>")))).alias("member"))
    who = codes.select(F.col("node").alias("member"), "code")
    if worst:
        last = F.when(F.size("scores") >= DEGREE, F.element_at("scores", -1)).otherwise(F.lit(float("-inf")).cast("float"))
        who = who.join(graph.select(F.col("node").alias("member"), last.alias("worst")), "member")
    return every.join(who, "member")


def build(tables: blocks.Tables, codes: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """(node, ids, scores): the graph, a written table; `codes` has (node, code)."""
    rng = np.random.default_rng(seed)
    sample = decode(pa.array([r.code for r in codes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("code").collect()], pa.binary()))
    trees = [tree(sample, DEPTH, rng) for _ in range(TREES)]
    aside = rng.normal(size=(TREES, sample.shape[1])).astype(np.float32)
    routed = codes.select("node", "code").mapInArrow(_router(trees, aside, DEPTH), "tree int, leaf long, side double, node long, code binary")
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * TREES / (16 * CHUNK)))
    ordered = routed.repartitionByRange(parts, "tree", "leaf", "side").sortWithinPartitions("tree", "leaf", "side")
    met = ordered.mapInArrow(_chunks, _GRAPH).withColumn("old", F.lit(False))
    graph = tables.keep(_gathered(codes.select("node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"), F.lit(True).alias("old")).unionByName(met)), "graph0")
    for k in range(1, MOST_ROUNDS + 1):
        around = _around(graph, codes, True).groupBy("node").agg(F.collect_list(F.struct("member", "code", "worst")).alias("m")).select("m")
        met = around.mapInArrow(_joined, _GRAPH).withColumn("old", F.lit(False))
        graph = tables.keep(_gathered(graph.select("node", "ids", "scores", F.lit(True).alias("old")).unionByName(met)), f"graph{k}")
        tables.forget(f"graph{k - 1}")
        moved = graph.agg(F.sum("changed").alias("new"), F.sum(F.size("ids")).alias("all")).first()
        if (moved.new or 0) <= LEAST_CHANGE * (moved["all"] or 0):
            break
    return graph


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, query code, least score of use, members, their codes) to (node, ids, scores) of members of use."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            lists = part.column(3)
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            score = np.einsum("ij,ij->i", decode(part.column(1))[row], decode(flat.field("code"))) if len(row) else np.zeros(0, np.float32)
            keep = score > part.column(2).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([part.column(0), *_lists(row[keep], part.num_rows, flat.field("member").to_numpy(zero_copy_only=False)[keep], score[keep])], ["node", "ids", "scores"])


def _hop(opened: int):
    """A function from rows (node, query, beam, done, finds) to the next beam and the nodes to open; `better` says whether the nearest changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beams, fronts, limits, seen, better = [], [], [], [], []
            for name, beam, done, finds in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                best = {e["id"]: e["score"] for e in beam}
                for f in finds:
                    best.update(zip(f["ids"], f["scores"], strict=True))
                best.pop(name, None)
                kept = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:BEAM]
                past = set(done)
                front = [i for i, _ in kept if i not in past][:opened]
                beams.append([{"id": i, "score": s} for i, s in kept])
                fronts.append(front)
                seen.append([i for i, _ in kept if i in past] + front)
                limits.append(kept[-1][1] if len(kept) == BEAM else float("-inf"))
                better.append([e["id"] for e in beam[:NEAREST]] != [i for i, _ in kept[:NEAREST]])
            kind = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float32())]))
            columns = [batch.column(0), batch.column(1), pa.array(beams, kind), pa.array(seen, pa.list_(pa.int64())), pa.array(fronts, pa.list_(pa.int64())), pa.array(limits, pa.float32()), pa.array(better, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "query", "beam", "done", "front", "least", "better"])

    return run


_STATE = "node long, query binary, beam array<struct<id:long,score:float>>, done array<long>, front array<long>, least float, better boolean"


def search(tables: blocks.Tables, asked: DataFrame, graph: DataFrame, codes: DataFrame, n: int) -> DataFrame:
    """(node, near): the best nodes found for each node of `asked` (node, query), itself left out."""
    spark = asked.sparkSession
    name, parts = f"hood_{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 8192))
    hood = _around(graph, codes, False).groupBy("node").agg(F.collect_list(F.struct("member", "code")).alias("m"))
    hood.repartition(parts, "node").write.bucketBy(parts, "node").sortBy("node").option("path", f"{tables.folder}/{name}").saveAsTable(name)
    try:
        hood = spark.table(name).withColumnRenamed("node", "opened")
        none = F.array().cast("array<struct<id:long,score:float>>")
        state = tables.keep(asked.select("node", "query", none.alias("beam"), F.array("node").alias("done"), F.array("node").alias("front"), F.lit(float("-inf")).cast("float").alias("least"), F.lit(True).alias("better")), "hop0")
        for k in range(1, MOST_HOPS + 1):
            front = state.select("node", "query", "least", F.explode("front").alias("opened"))
            finds = front.join(hood, "opened").select("node", "query", "least", "m").mapInArrow(_scored, _GRAPH)
            finds = finds.where(F.size("ids") > 0).groupBy("node").agg(F.collect_list(F.struct("ids", "scores")).alias("finds"))
            both = state.join(finds, "node", "left").select("node", "query", "beam", "done", F.coalesce("finds", F.array().cast("array<struct<ids:array<long>,scores:array<float>>>")).alias("finds"))
            state = tables.keep(both.mapInArrow(_hop(HOPS[min(k, len(HOPS) - 1)]), _STATE), f"hop{k}")
            if k >= len(HOPS) and (state.agg(F.avg(F.col("better").cast("int")).alias("share")).first().share or 0) < LEAST_BETTER:
                break
        return state.select("node", F.explode(F.slice("beam.id", 1, EXACT)).alias("near"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Neighbourhoods are some kilobytes a row: Python workers get few of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def nearest(vectors: DataFrame, step: int = QUERY_STEP, most: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `most` nearest found for every id that `step` divides."""
    spark = vectors.sparkSession
    tables = blocks.Tables(spark)
    rows = usable(vectors)
    longest = rows.agg(F.max(F.size("v")).alias("d")).first().d
    if not longest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = tables.keep(rows.where(F.size("v") == longest).groupBy("vec_id").agg(F.min("v").alias("v")), "rows")
    nodes = tables.keep(nodes_of(rows, most), "nodes")
    largest = nodes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("m")).first().m
    square = nodes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))).alias("s"), F.count(F.lit(1)).alias("n")).first()
    coded = nodes.select("node", "v").mapInArrow(_coder(largest, math.sqrt(square.s)), "node long, code binary, query binary")
    codes = tables.keep(coded, "codes")
    own = tables.keep(rows.where(F.col("vec_id") % step == 0).join(nodes.select("node", "v"), "v").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    asked = codes.select("node", "query").join(own.select("node").distinct(), "node", "left_semi")
    with _small_batches(spark):
        found = tables.keep(search(tables, asked, build(tables, codes, square.n), codes, square.n), "found")

    # Exact products; a query's own node stays a candidate for its other copies.
    pairs = tables.keep(asked.select("node", F.col("node").alias("near")).unionByName(found), "pairs")
    product = F.aggregate(F.zip_with("a", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.join(nodes.select(F.col("node").alias("near"), "v", "ids"), "near").join(nodes.select("node", F.col("v").alias("a")), "node").select("node", product.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    lists = exact.select("*", F.row_number().over(order).alias("k")).where(F.col("k") <= most + 1)
    lists = lists.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, most)
    return own.join(lists, "node").select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
