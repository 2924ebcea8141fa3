"""Near-duplicate documents: BagMinHash signatures, bands, exact multiset overlap.

A text is the multiset of its runs of five lower-cased words; the similarity of
two texts is the weighted Jaccard similarity of these multisets (the sum of the
lesser counts over the sum of the greater ones), and texts of 0.8 or more are
linked. The classes are the connected components of the links.

BagMinHash: each shingle owns Poisson processes over the discretised weights
[0, 1), [1, 2), [2, 4), [4, 8), ... A point carries a time, a register and a
level inside its strip; a strip that a weight only partly covers is halved
until every half is in or out, which the bits of the level decide. A register
keeps the least time of the points below the shingle's count. Processes are
advanced until no point can change the text's largest register, so a text costs
about its number of shingles plus m log m points, not their product.

Copies of equal text are one class before any comparison, so their number never
matters. Within a bucket, members are compared with a leader, not with each other: pairs
that both match the leader are already connected. Members that failed, and
might still be linked to each other, go through an exact filter on the entries
that they share.

Defined results: null and empty texts (no word) are never linked to anything;
a text of fewer than five words is one shingle; repeated rows are copies; ties
between ids or leaders go to the least id and the greatest digest; a very long
text is one slice of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

BANDS, ROWS = 26, 5
SIMILARITY = 0.8
WORDS = 5


def bags(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of all texts, ordered by row and shingle."""
    buf, offsets = blocks.text_buffer(texts)
    row, key = blocks.shingles(blocks.segment(blocks.fold_case(buf), offsets), width)
    if not len(key):
        return row, key, np.zeros(0, np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], key[at], np.diff(np.append(at, len(key)))


def bagminhash(row: np.ndarray, key: np.ndarray, count: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (float64 times, n_rows x m) of the bags; infinite for rows without a shingle."""
    registers = np.full((n_rows, m), np.inf)
    if not len(key):
        return registers
    top = int(count.max()).bit_length() + 1
    rows, keys, weights, starts, widths, strips = [], [], [], [], [], []
    for strip in range(top):
        start, width = (0, 1) if strip == 0 else (1 << (strip - 1), 1 << (strip - 1))
        has = count > start
        if has.any():
            rows.append(row[has])
            keys.append(blocks.mix(key[has] + np.uint64(strip * 0x9E3779B97F4A7C15 & blocks._MASK)))
            weights.append(count[has])
            starts.append(np.full(has.sum(), start, np.float64))
            widths.append(np.full(has.sum(), width, np.float64))
    rows, keys, weights, starts, widths = map(np.concatenate, (rows, keys, weights, starts, widths))
    order = np.argsort(rows, kind="stable")
    rows, keys, weights, starts, widths = (x[order] for x in (rows, keys, weights, starts, widths))
    time, step, flat = np.zeros(len(keys)), 0, registers.reshape(-1)
    while len(keys):
        batch = int(np.clip(200_000 // len(keys), 1, 48))
        with np.errstate(over="ignore"):
            points = blocks.mix(keys[:, None] + (np.arange(step, step + batch, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        step += batch
        uniform = ((points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        # Added one after another onto the running time: batch borders, which other texts decide, leave no trace in the last bits.
        waits = -np.log(uniform) / widths[:, None]
        waits[:, 0] += time
        times = np.cumsum(waits, axis=1)
        drawn = blocks.mix(points ^ np.uint64(0xE7037ED1A0B428DB))
        level = starts[:, None] + widths[:, None] * ((drawn >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        register = (drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)
        inside = level < weights[:, None]
        np.minimum.at(flat, (rows[:, None] * m + register.astype(np.int64))[inside], times[inside])
        time = times[:, -1]
        live, inverse = np.unique(rows, return_inverse=True)
        keep = time <= registers[live].max(axis=1)[inverse]
        rows, keys, weights, starts, widths, time = (x[keep] for x in (rows, keys, weights, starts, widths, time))
    return registers


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = blocks.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for part in blocks.text_slices(batches):
        texts = part.column(1)
        row, key, count = bags(texts)
        n = len(texts)
        registers = bagminhash(row, key, count, n).view(np.uint64).reshape(n, BANDS, ROWS)
        acc = np.broadcast_to(salt, (n, BANDS)).copy()
        for k in range(ROWS):
            acc = blocks.mix(acc ^ registers[:, :, k]) + np.uint64(k)
        size = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        digests = [hashlib.md5((x.as_py() or "").encode()).digest() for x in texts]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(acc.view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(size), bands], ["doc_id", "cls", "size", "bands"])


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of each pair of texts, from the whole multisets."""
    n = len(left)
    lr, lk, lc = bags(left)
    rr, rk, rc = bags(right)
    row, key, count = np.concatenate([lr, rr]), np.concatenate([lk, rk]), np.concatenate([lc, rc])
    order = np.lexsort((key, row))
    row, key, count = row[order], key[order], count[order]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1])) if len(row) else np.zeros(0, np.int64)
    both = np.bincount(row[twice], weights=np.minimum(count[twice], count[twice + 1]), minlength=n)
    total = np.bincount(row, weights=count, minlength=n)
    return both / np.maximum(total - both, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.text_slices(batches, "left_text", blocks.SLICE_BYTES // 2):
        s = weighted_jaccard(part.column(2), part.column(3))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s)], ["leader", "cls", "similarity"])


def _judge(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, cls, similarity) of the pairs; `texts` holds (cls, text) once for each class.

    The members' texts are fetched first: a leader of many then meets their
    rows, sorted, and its text crosses the network once for each task.
    """
    own = pairs.select("leader", "cls").join(texts.withColumnRenamed("text", "right_text"), "cls")
    both = own.join(texts.select(F.col("cls").alias("leader"), F.col("text").alias("left_text")), "leader")
    return both.select("leader", "cls", "left_text", "right_text").mapInArrow(_verify, "leader binary, cls binary, similarity double")


def _near_size(a: str, b: str, similarity: float) -> Column:
    """Bags of very different sizes can't be that similar."""
    return (F.col(a) >= similarity * F.col(b)) & (F.col(b) >= similarity * F.col(a))


def _open_members(met: DataFrame, seen: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(cls) that can be linked to others of a bucket in ways not yet seen.

    The leader has met everyone of its bucket, or differs too much in size. As
    1 - similarity is a metric, a member that passed has no unseen link to one
    that failed if it is much nearer to the leader than the best of those. A
    bucket whose open members are all connected already is settled.
    """
    bound = F.least("size", "leader_size") / F.greatest("size", "leader_size")
    judged = met.join(seen, ["leader", "cls"], "left").withColumn("similarity", F.coalesce("similarity", bound))
    failed = F.col("similarity") < similarity
    best = judged.where(failed).groupBy("bucket").agg(F.max("similarity").alias("best"))
    reached = judged.join(best, "bucket").where(failed | (F.col("similarity") <= F.col("best") + (1 - similarity)))
    named = reached.join(parts, "cls", "left").select("bucket", "cls", F.coalesce("part", "cls").alias("part"))
    apart = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high")
    return named.join(apart.select("bucket"), "bucket", "left_semi").select("cls").distinct()


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.text_slices(batches, "text", blocks.SLICE_BYTES // 2):
        row, key, count = bags(part.column(1))
        size = np.bincount(row, weights=count, minlength=part.num_rows).astype(np.int64)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, key = np.repeat(row, count), blocks.mix(np.repeat(key, count) + nth.astype(np.uint64))
        for k in range(0, len(row), 200_000):
            at = row[k : k + 200_000]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(size[at]), pa.array(key[k : k + 200_000].view(np.int64))], ["cls", "size", "token"])


def _open_pairs(tables: blocks.Tables, still: DataFrame, texts: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(leader, cls) of the pairs of classes `still` that may be linked and aren't connected, by an exact filter.

    With the common entries of every multiset in one order, rarest first, two
    linked classes meet in the bucket of the first entry that they share, and
    all that they share stands there or later in both. So a class stays in a
    bucket only if enough follows for a link to the smallest other class. Texts
    alike in a common passage have rare entries of their own in front, edited copies
    far from all others have too few common ones; both leave. In a bucket, the
    members of the part that most belong to need no pairs among themselves.
    """
    entries = tables.keep(texts.join(still, "cls", "left_semi").select("cls", "text").mapInArrow(_expanded, "cls binary, size long, token long"), "entries")
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    w = Window.partitionBy("cls")
    ranked = entries.join(often, "token").select("cls", "token", "size", F.row_number().over(w.orderBy("df", "token")).alias("at"), F.count(F.lit(1)).over(w).alias("common"))
    rare = ranked.select("cls", F.col("token").alias("bucket"), "size", (F.col("common") - F.col("at") + 1).alias("rest")).where(F.col("rest") >= similarity * F.col("size"))
    rare = tables.keep(rare.join(parts, "cls", "left").select("bucket", "cls", "size", "rest", F.coalesce("part", "cls").alias("part")), "rare")
    smallest = rare.groupBy("bucket").agg(F.min("size").alias("smallest"))
    enough = F.col("rest") >= _least_overlap(F.col("size"), F.greatest(F.col("smallest"), F.ceil(similarity * F.col("size") - 1e-6)), similarity)
    fitting = tables.keep(rare.join(smallest, "bucket").where(enough).drop("smallest"), "fitting")
    most = fitting.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.count(F.lit(1)).alias("parts"))
    open_ = tables.keep(fitting.join(most.where("parts > 1").select("bucket", F.col("m.part").alias("main")), "bucket"), "open")
    apart = open_.where("part != main")
    other = open_.select("bucket", F.col("cls").alias("b"), F.col("part").alias("b_part"), F.col("size").alias("b_size"), F.col("rest").alias("b_rest"))
    once = (F.col("b_part") == F.col("main")) | (F.col("b") < F.col("cls"))
    met = (F.col("part") != F.col("b_part")) & once & (F.least("rest", "b_rest") >= _least_overlap(F.col("size"), F.col("b_size"), similarity))
    pairs = apart.join(other, (apart.bucket == other.bucket) & met)
    return pairs.select(F.least("b", "cls").alias("leader"), F.greatest("b", "cls").alias("cls")).distinct()


def _least_overlap(a: Column, b: Column, similarity: float) -> Column:
    """Entries that two multisets of these sizes share at least if they are that similar."""
    return F.ceil(similarity / (1 + similarity) * (a + b) - 1e-6)


def _texts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, text) once for each class of `members`, taken from the row of its least id."""
    wanted = blocks.bounded(members.select("cls", F.col("class_id").alias("doc_id")))
    own = rows.withColumn("cls", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    found = own.alias("o").join(wanted.alias("w"), (F.col("o.cls") == F.col("w.cls")) & F.col("o.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    return found.select("o.cls", "o.text").dropDuplicates(["cls"])


def classes_of(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(signed, groups): (doc_id, cls, size) of every row, and (cls, class_id, group) of every class that has words.

    Each step is a table of its own. First every class meets the leader of each
    of its buckets, the class that meets most others. The members of buckets
    that this leaves open meet again by their rarest entries, which loses no
    pair.
    """
    tables = blocks.Tables(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = tables.keep(rows.mapInArrow(_signatures, "doc_id long, cls binary, size long, bands array<long>"), "signed")
    classes = tables.keep(signed.where("size > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")

    each = classes.select("cls", "size", "class_id", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = each.join(shared, "bucket").groupBy("cls").agg(F.sum("n").alias("weight"), F.min("class_id").alias("class_id"), F.min("size").alias("size"), F.collect_list("bucket").alias("buckets"))
    members = tables.keep(met, "members")
    inside = members.select("cls", "size", "weight", F.explode("buckets").alias("bucket"))
    first = inside.groupBy("bucket").agg(F.max(F.struct("weight", "cls", "size")).alias("l"))
    led = inside.join(first, "bucket").where(F.col("cls") != F.col("l.cls"))
    todo = tables.keep(led.select("bucket", "cls", "size", F.col("l.cls").alias("leader"), F.col("l.size").alias("leader_size")), "todo")
    texts = tables.keep(_texts(rows, members), "texts")
    # A class often meets the same leader in several buckets: each pair is judged once.
    seen = tables.keep(_judge(todo.where(_near_size("size", "leader_size", similarity)).select("leader", "cls").distinct(), texts), "seen")
    linked = seen.where(F.col("similarity") >= similarity)
    parts = tables.keep(_parts(linked, None), "parts")
    left = tables.keep(_open_members(todo, seen, parts, similarity), "left")
    tables.forget("members", "todo")

    found = linked
    if not left.isEmpty():
        pairs = _open_pairs(tables, left, texts, parts, similarity)
        new = tables.keep(_judge(pairs.join(seen, ["leader", "cls"], "left_anti"), texts), "new")
        found = linked.unionByName(new.where(F.col("similarity") >= similarity))
    parts = _parts(found.select("leader", "cls"), parts)
    group = classes.select("cls", "class_id").join(parts, "cls", "left")
    return signed.select("doc_id", "cls", "size"), tables.keep(group.select("cls", "class_id", F.coalesce("part", "cls").alias("group")), "groups")


def _parts(links: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(cls, part): the component of every linked class, from the links (leader, cls) and the components known before.

    Each class stands for its greatest neighbour, or for its known component, so that only few nodes are left to connect.
    """
    if parts is None:
        both = links.select("leader", "cls").unionByName(links.select(F.col("cls").alias("leader"), F.col("leader").alias("cls")))
        parts = blocks.Tables(links.sparkSession).keep(both.groupBy("cls").agg(F.greatest(F.max("leader"), F.col("cls")).alias("part")), "near")
    a, b = (parts.select(F.col("cls").alias(c), F.col("part").alias(f"{c}_part")) for c in ("leader", "cls"))
    ends = links.join(a, "leader", "left").join(b, "cls", "left").select("leader", "cls", F.coalesce("leader_part", "leader").alias("a"), F.coalesce("cls_part", "cls").alias("b"))
    roots = components(ends.where("a != b").select("a", "b").distinct())
    nodes = parts.select("cls", "part").unionByName(ends.select(F.col("leader").alias("cls"), F.col("a").alias("part"))).unionByName(ends.select("cls", F.col("b").alias("part"))).distinct()
    return nodes.join(roots.withColumnRenamed("node", "part"), "part", "left").select("cls", F.coalesce("root", "part").alias("part"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node of its component.

    Labels fall to the least label of the neighbours and of their own label's
    label, until none changes. No component meets in one task.
    """
    tables = blocks.Tables(edges.sparkSession)
    both = tables.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = tables.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "label")
    step, moved = 0, not both.isEmpty()
    while moved:
        step += 1
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = label.join(jump, "root", "left").join(near, "node", "left")
        new = tables.keep(new.select("node", F.col("root").alias("was"), F.least("root", "near", "far").alias("root")), f"label{step}")
        moved = not new.where(F.col("root") != F.col("was")).isEmpty()
        label = new.select("node", "root")
    return label


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_id, has_words) of every row.

    class_id is the least id of all rows that links connect, copy_id that of
    the rows of equal text.
    """
    signed, groups = classes_of(docs, similarity)
    least = groups.groupBy("group").agg(F.min("class_id").alias("least"))
    named = groups.join(least, "group").select("cls", F.col("class_id").alias("copy_id"), "least")
    # A text without a word is a class with its copies, and linked to nothing.
    blank = signed.where("size = 0").groupBy("cls").agg(F.min("doc_id").alias("copy_id")).select("cls", "copy_id", F.col("copy_id").alias("least"))
    out = signed.join(named.unionByName(blank), "cls")
    return out.select("doc_id", F.col("least").alias("class_id"), "copy_id", (F.col("size") > 0).alias("has_words"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that copy, or nearly copy, one of a lesser id. Texts without a word all stay.

    Rows are told apart by id and text: of rows that are equal in both one stays.
    """
    tables = blocks.Tables(docs.sparkSession)
    signed, groups = classes_of(docs, similarity)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "cls")).alias("k"))
    keepers = groups.join(first, "group").select("cls", F.when(F.col("cls") == F.col("k.cls"), F.col("class_id")).alias("keep"), (F.col("cls") == F.col("k.cls")).alias("stays"))
    goes = ~F.col("stays") | ~F.col("doc_id").eqNullSafe(F.col("keep"))
    judged = signed.where("size > 0").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("n")).join(keepers, "cls").select("doc_id", "cls", goes.alias("goes"), "n")
    judged = tables.keep(judged.where("goes or n > 1"), "judged")
    names, key = docs.columns, [F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("_cls")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *key)

    def same(side: str) -> Column:
        return (F.col("_cls") == F.col(f"{side}.cls")) & F.col("_id").eqNullSafe(F.col(f"{side}.doc_id"))

    kept = rows.join(blocks.bounded(judged.where("goes").select("doc_id", "cls")).alias("g"), same("g"), "left_anti")
    twice = judged.where("not goes").select("doc_id", "cls")
    if not twice.isEmpty():
        twice = blocks.bounded(twice)
        kept = kept.join(twice.alias("t"), same("t"), "left_anti").unionByName(kept.join(twice.alias("t"), same("t"), "left_semi").dropDuplicates(["_id", "_cls"]))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
