"""Near duplicates by Jaccard similarity of word shingles: SimHash and MinHash candidates, every link confirmed in full.

Each distinct set of shingles is a node. Candidates come from the Gray-order index
over SimHash fingerprints, which finds close copies, and from banded MinHash: at a
similarity of 0.8 fingerprints mostly differ by more bits than the index can bound.
With 24 bands of 6, a pair of similarity 0.8 shares a bucket with probability 0.9993
and one of 0.85 with 0.99999; nothing else is lost.

All pairs of a bucket are never written. First each member is compared with the
smallest of its bucket, the centre. Buckets whose members are then still in
different classes form the group of their centre, and each group gets a pivot: the
shingles that most of a few members have. Let d(x) be the shingles in which x and
the pivot differ. Members a and b are similar only if their sets differ in at most
(1 - least) / (1 + least) of |a| + |b| shingles, so d(a) and d(b) must share at least
(f(a) + f(b)) / 2 shingles, f(x) = |d(x)| - |x| (1 - least) / (1 + least). Where that
is zero or less, both are similar to the member of least f and meet there. Else one
of them comes first in a common order and stands early in both lists: lists are
joined on the first shingles only, those that the pivot lacks first, as these are
rare, and a match that comes too late to leave enough shared shingles is dropped in
the join. The pivot decides how many pairs are compared, never which are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .simhash import SLICE_BYTES, fingerprint_links, majority, shingle_hashes
from .textkit import as_bytes, mix64, slices, sql_type, store

BANDS, ROWS = 24, 6
PART = 1 << 10
#: Members of a group that make its pivot.
PIVOT_MEMBERS = 32
SLACK = 1e-9


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def node_of(values: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return xxhash.xxh3_128_digest(values.tobytes())


def band_keys(values: np.ndarray) -> np.ndarray | None:
    """A key per band from the least of ``ROWS`` hashes each; none for an empty set."""
    if not len(values):
        return None
    seeds = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), PART):
        part = values[at:at + PART, None]
        low = np.minimum(low, ((part ^ seeds) * (seeds | np.uint64(1))).min(axis=0))
    bands = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def _node_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            hashes = [np.array(shingle_hashes(t, width), dtype=np.uint64) for t in as_bytes(batch.column(1))]
            prints = majority(np.concatenate(hashes), np.array(list(map(len, hashes)), dtype=np.int64))
            sets = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([node_of(s) for s in sets], pa.binary()), pa.array(prints.view(np.int64)),
                 pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], ["id", "key", "node", "fp", "bands"])
    return run


def _set_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0, size=SLICE_BYTES):
            sets = [shingle_set(t, width) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "members"])
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose ``sets (node, members)`` have the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("two"))
    n, m = F.size("one"), F.size("two")
    near = F.least(n, m) >= least * F.greatest(n, m) - SLACK
    both = F.when(near, F.size(F.array_intersect("one", "two"))).otherwise(0)
    return pairs.join(one, "a").join(two, "b").filter(near & (both >= least * (n + m - both) - SLACK)).select("a", "b")


def _whole(x: Column) -> Column:
    """The least whole number that is not below ``x``, at least one."""
    return F.greatest(F.lit(1), F.ceil(x - SLACK)).cast("int")


def open_pairs(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` to be confirmed so that no link between members of a group of ``groups (group, node, root)`` that
    are in different classes is lost: see the head of this module."""
    share = (1 - least) / (1 + least)
    rank = F.row_number().over(Window.partitionBy("group").orderBy("node"))
    few = groups.select("group", "node").withColumn("rank", rank).filter(F.col("rank") <= PIVOT_MEMBERS)
    halves = few.groupBy("group").agg((F.count("*") / 2).alias("half"))
    pivots = (few.join(sets, "node").select("group", F.explode("members").alias("shingle")).groupBy("group", "shingle").count()
              .join(halves, "group").filter(F.col("count") > F.col("half")).groupBy("group").agg(F.collect_list("shingle").alias("pivot")))
    apart = groups.join(sets, "node").join(pivots, "group", "left").withColumn("pivot", F.coalesce("pivot", F.array().cast("array<bigint>")))
    lists = store(apart.select("group", "node", "root", F.size("members").alias("size"), F.concat(
        F.array_sort(F.array_except("members", "pivot")), F.array_sort(F.array_except("pivot", "members"))).alias("d")), "differences")
    lists = lists.withColumn("f", F.size("d") - share * F.col("size"))
    nearest = lists.groupBy("group").agg(F.min(F.struct("f", "node", "root")).alias("nearest"))
    placed = lists.join(nearest, "group")
    sure = placed.filter((F.col("root") != F.col("nearest.root")) & (F.col("f") + F.col("nearest.f") <= SLACK)).select(
        F.least("node", "nearest.node").alias("a"), F.greatest("node", "nearest.node").alias("b"))
    n = F.size("d")
    keys = placed.select("group", "node", "root", "size", "f", n.alias("n"), (n - _whole(F.col("f")) + 1).alias("short"),
                         F.posexplode(F.slice("d", F.lit(1), F.greatest(n - _whole((F.col("f") + F.col("nearest.f")) / 2) + 1, F.lit(0))))
                         .alias("at", "shingle"))
    keys = store(keys.withColumn("short", F.col("at") < F.col("short")).withColumn("left", F.col("n") - F.col("at")).drop("n", "at"), "prefixes")
    one = keys.select("group", "shingle", *[F.col(c).alias(f"{c}1") for c in ("node", "root", "size", "f", "left")])
    two = keys.filter("short").select("group", "shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "size", "f", "left")])
    need = F.col("f1") + F.col("f2")
    fits = ((F.col("root1") != F.col("root2")) & (F.struct("f1", "node1") > F.struct("f2", "node2")) & (need > SLACK)
            & (F.least("left1", "left2") >= need / 2 - SLACK) & (F.least("size1", "size2") >= least * F.greatest("size1", "size2") - SLACK))
    met = one.join(two, ["group", "shingle"]).filter(fits).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))
    return met.unionByName(sure).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    least: float = 0.8) -> DataFrame:
    """Per row of ``docs``: ``id_col`` and ``component_id``, the smallest id reachable over pairs of texts whose sets of
    ``width``-word shingles have a Jaccard similarity of ``least`` or more.

    Null and blank texts have the same, empty set. Repeated rows each come back. Rows whose id is null take part in
    links but never name a component. Other columns are not looked at. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = store(texts.mapInArrow(_node_task(width), f"id {sql_type(docs, id_col)}, key bigint, node binary, fp bigint, bands array<bigint>"), "nodes")
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    centres = keyed.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = store(keyed.join(centres, "band"), "buckets")
    # nodes of close fingerprints, each with the first node of the fingerprint it is linked to
    prints = store(rows.filter("bands IS NOT NULL").select("node", "fp").distinct(), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("node").alias("first"))
    close = fingerprint_links(first.select("fp"))
    linked = (close.join(first.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a")
              .join(first.select(F.col("fp").alias("b"), F.col("first").alias("two")), "b").select("one", "two"))
    by_print = linked.union(prints.join(first, "fp").select("first", "node")).toDF("a", "b")
    by_band = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    pairs = store(by_print.union(by_band).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    # one text of every node that is in a pair
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = (rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "key")).alias("c"))
              .select(F.col("c.id").alias("_id"), F.col("c.key").alias("_key")).distinct())
    sets = store(texts.join(chosen, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
                 .mapInArrow(_set_task(width), "node binary, members array<bigint>").dropDuplicates(["node"]), "sets")

    stars = store(confirmed(pairs, sets, least), "stars")
    roots = components(stars)
    # a bucket of two is settled by its star
    placed = (members.filter("n > 2").join(roots, "node", "left").select("band", "centre", "node", F.coalesce("root", "node").alias("root")))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    groups = store(placed.join(split, "band", "left_semi").select(F.col("centre").alias("group"), "node", "root").distinct(), "groups")
    more = confirmed(open_pairs(groups, sets, least), sets, least)
    whole = components(store(stars.union(more), "links"))
    classes = (nodes.select("node", "least").join(whole, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = classes.join(named, "root").select("node", "component_id")
    return rows.join(of_node, "node").select(F.col("id").alias(id_col), "component_id")
