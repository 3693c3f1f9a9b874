"""Near-duplicate detection by BagMinHash.

A text is the multiset of its shingles of ``SHINGLE`` words (runs of letters and digits in
lower case; a shorter text is one shingle of all its words).  For every shingle, Poisson
processes run over its discretised weight: one over [0, 1) and one over each dyadic range
[2^j, 2^(j+1)), the last thinned by the place of its points to what the weight covers.
Each point falls in one of ``REGISTERS`` registers, and a register keeps the earliest
point over all shingles, so two signatures agree in a register with a probability of
exactly their weighted Jaccard similarity.  The processes are followed up to a time at
which a text's registers are filled; texts with an empty one go on to twice that time.

Texts with equal multisets form one node.  Nodes that share a band (``ROWS`` registers)
are candidates: at similarity 0.8 a pair is missed by all ``REGISTERS / ROWS`` bands with
a probability of 5e-6.  Pairs from buckets of up to ``SMALL`` nodes are joined with their
multisets.  Nodes of larger buckets form clusters, whose multisets are compared through
an inverted index, each pair exactly; clusters beyond ``CLUSTER`` nodes are split into
pairs of blocks.  A cluster returns a spanning forest of its links and how many each node
has, so nothing quadratic is written, while every link is counted.  Classes are the
connected components of the verified links.  ``n_links`` of a document is the number of
other documents at ``similarity`` or more, copies included.

Edge cases: texts that are null, empty or without a word are alone in their class.
Repeated rows are copies of each other.  A class is named by its least doc_id.  Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS, ROWS = 240, 6
SMALL, CLUSTER = 64, 4096
_FULL = np.uint64(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the first one of each text."""
    low = C.LOWER[data]
    starts, ends, first = C.runs(C.ALNUM[low], offsets)
    words = C.spans_hash(C.prefix_hash(low), starts, ends)
    count = np.diff(first)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], size)
    left = np.repeat(first[1:], size)
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        inside = at + j < left
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.minimum(at + j, max(0, len(words) - 1))], np.uint64(j + 1)) if len(words) else out
    return C.mix(out), begin


def weighted(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash (52 bits) and weight of each distinct shingle of each text, in order of text and hash."""
    text = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    keys, weight = np.unique((text << np.uint64(52)) | (hashes >> np.uint64(12)), return_counts=True)
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1), weight


def signatures(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers times of the earliest points; inf for texts without shingles."""
    out = np.full((n, registers), np.inf)
    ranges = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(text)), ranges)
    level = np.arange(len(at)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    seed = C.mix(hashes[at] + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25))
    of, top = text[at], weight[at].astype(float)
    total = np.bincount(text, weight, n)
    limit = registers * (np.log(registers) + 3) / np.maximum(total, 1)
    todo = np.arange(len(at))
    while len(todo):
        here, time, step = todo, np.zeros(len(todo)), 0
        while len(here):
            step += 1
            draw = C.mix(seed[here] + np.uint64(step * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate[here]
            live = time <= limit[of[here]]
            here, time, draw = here[live], time[live], C.mix(draw[live] ^ np.uint64(0x8CB92BA72F3D8DD7))
            register = ((draw >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            inside = low[here] + rate[here] * ((draw & _FULL).astype(np.float64) * 2.0**-32) < top[here]
            np.minimum.at(out.reshape(-1), of[here[inside]] * registers + register[inside], time[inside])
        lacking = np.isinf(out).any(axis=1) & (total > 0)
        limit = np.where(lacking, limit * 2, limit)
        todo = todo[lacking[of[todo]]]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    bits = signature.view(np.uint64).reshape(len(signature), -1, rows)
    out = np.zeros(bits.shape[:2], np.uint64)
    for j in range(rows):
        out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return C.mix(out + np.arange(out.shape[1], dtype=np.uint64))


def signed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, one, two, bands): size and fingerprint of the multiset, bands null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(2))
            parts = []
            for lo, hi, part, off in C.groups(data, offsets):
                hashes, begin = shingles(part, off)
                text, key, weight = weighted(hashes, begin)
                code = C.mix(key + weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                prints = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                for k, out in enumerate(prints):
                    np.add.at(out, text, C.mix(code ^ np.uint64(0x165667B19E3779F9 * (k + 1))))
                parts.append((np.diff(begin), prints[0], prints[1], bands(signatures(text, key, weight, hi - lo))))
            if not parts:
                continue
            n, one, two, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys = keys[n > 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), C.list_array(pa.array(keys.reshape(-1).view(np.int64)), np.where(n > 0, REGISTERS // ROWS, 0))],
                ["row", "doc_id", "n", "one", "two", "bands"],
            )

    return docs.mapInArrow(run, "row long, doc_id long, n long, one long, two long, bands array<long>")


def multisets(docs: DataFrame) -> DataFrame:
    """(node, items): sorted hashes of (shingle, its occurrence), so that set overlap is multiset overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            items, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, part, off in C.groups(data, offsets):
                hashes, begin = shingles(part, off)
                text, key, weight = weighted(hashes, begin)
                again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                items.append(C.mix(np.repeat(key, weight) + again.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)))
                sizes.append(np.diff(begin))
            yield pa.RecordBatch.from_arrays([batch.column(0), C.list_array(pa.array(np.concatenate(items).view(np.int64)), np.concatenate(sizes))], ["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


def spanning_links(items: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between ``left`` and ``right`` members, found through an inverted index, and all links of each member, by copies."""
    size = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(len(items)), size)
    _, item = np.unique(np.concatenate(items), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(item, kind="stable")
    posted = owner[order]
    bounds = np.searchsorted(item[order], np.arange(item.max(initial=-1) + 2))
    parent = np.arange(len(items))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    links = np.zeros(len(items), np.int64)
    within = bool((left & right).all())
    for x in np.flatnonzero(left):
        own = item[first[x] : first[x + 1]]
        count = bounds[own + 1] - bounds[own]
        at = np.repeat(bounds[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(posted[at], minlength=len(items))
        union = size[x] + size - shared
        near = np.flatnonzero(right & (shared >= similarity * union) & (np.arange(len(items)) != x))
        links[x] += copies[near].sum()
        if not within:  # blocks meet once, so the other side is counted here
            links[near] += copies[x]
        for y in near.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                out.append((int(x), y))
    return out, links


def _with_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def find(docs: DataFrame, similarity: float = SIMILARITY, small: int = SMALL, cluster: int = CLUSTER) -> DataFrame:
    """(row, doc_id, class_id, n_links) for every document: its class, and its number of verified links."""
    return _found(docs, similarity, small, cluster).drop("class_row")


def _found(docs: DataFrame, similarity: float, small: int = SMALL, cluster: int = CLUSTER) -> DataFrame:
    """As ``find``, and class_row: a row of the class, which tells classes apart where ids are null or repeat."""
    spark = docs.sparkSession
    C.short_batches(spark)
    rows = _with_rows(C.stable(docs))
    prints = C.written(signed(rows), "bag-signatures")
    nodes = C.written(prints.where("n > 0").groupBy("one", "two").agg(F.min("row").alias("node"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min_by("bands", "row").alias("bands")), "bag-nodes")
    spread = nodes.select("node", "n", "copies", F.explode("bands").alias("band"))
    crowded = spread.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = C.written(spread.join(crowded, "band"), "bag-members")
    # Pairs of small buckets: at most small * (small - 1) / 2 for a bucket.
    listed = members.where(F.col("members") <= small).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("n", "node", "copies"))).alias("nodes"))
    paired = listed.select(F.explode(F.expr(
        f"flatten(transform(nodes, (x, i) -> filter(transform(slice(nodes, i + 2, {small}), y -> struct(x.node AS a, y.node AS b, x.n AS na, y.n AS nb, x.copies AS ca, y.copies AS cb)), z -> z.na >= {similarity} * z.nb)))"
    )).alias("p")).select("p.*").distinct()
    large = members.where(F.col("members") > small)
    stars = large.join(large.groupBy("band").agg(F.min("node").alias("hub")), "band").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    clusters = C.written(components(stars), "bag-clusters")
    # Pairs within one cluster are compared there.
    own = clusters.select("node", "component")
    paired = paired.join(own.toDF("a", "in_a"), "a", "left").join(own.toDF("b", "in_b"), "b", "left")
    pairs = C.written(paired.where(~F.coalesce(F.col("in_a") == F.col("in_b"), F.lit(False))).drop("in_a", "in_b"), "bag-pairs")
    C.free(members)
    needed = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(clusters.select("node")).distinct()
    sets = C.written(multisets(rows.hint("merge").join(needed, "row").select(F.col("row").alias("node"), "text")), "bag-sets")
    near = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    near = near.where(shared >= similarity * (F.col("na") + F.col("nb") - shared)).select("a", "b", "ca", "cb")
    links = C.written(near.unionByName(_within(clusters.join(nodes.select("node", "copies"), "node"), sets, similarity, cluster)), "bag-links")
    C.free(pairs, sets)
    named = components(links.where("b >= 0").select("a", "b"))
    degree = links.select(F.col("a").alias("node"), F.col("cb").alias("links")).union(links.where("b >= 0").select("b", "ca")).groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = nodes.select("one", "two", "node", "copies").join(named, "node", "left").join(degree, "node", "left")
    nodes = nodes.select("one", "two", F.coalesce("component", "node").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = C.written(prints.select("row", "doc_id", "one", "two", F.col("n") > 0).toDF("row", "doc_id", "one", "two", "worded").join(nodes.withColumn("worded", F.lit(True)), ["one", "two", "worded"], "left"), "bag-placed")
    names = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return placed.join(names, "component", "left").select("row", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("class_row"))


def _within(clusters: DataFrame, sets: DataFrame, similarity: float, limit: int) -> DataFrame:
    """Links (a, b, ca, cb) within clusters (component, node, copies), from pairs of blocks of about ``limit`` / 2 members (one block where that is enough).

    Links of the spanning forest carry 0 copies; rows with b = -1 tell all links of a as cb.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", F.when(F.col("size") <= limit, 1).otherwise(F.ceil(F.col("size") * 2 / limit)).cast("int"))
    placed = clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = placed.select("component", "node", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", "node", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes = pdf.node.to_numpy()
        found, links = spanning_links([np.asarray(x, np.int64) for x in pdf["items"]], pdf.copies.to_numpy(np.int64), (pdf.own == pdf.i).to_numpy(), (pdf.own == pdf.j).to_numpy(), similarity)
        some = np.flatnonzero(links)
        at = np.array(found, np.int64).reshape(-1, 2)
        none = np.zeros(len(at), np.int64)
        rows = [np.concatenate(x) for x in ((nodes[at[:, 0]], nodes[some]), (nodes[at[:, 1]], np.full(len(some), -1)), (none, 0 * some), (none, links[some]))]
        return pd.DataFrame(dict(zip(("a", "b", "ca", "cb"), rows, strict=True))).astype("int64")

    return dealt.join(sets, "node").groupBy("component", "i", "j").applyInPandas(compare, "a long, b long, ca long, cb long")


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of least doc_id (then the first of its rows), whole and with all columns."""
    docs = C.stable(docs)
    row = C.fresh(docs, "row")
    found = _found(docs, similarity)
    kept = found.groupBy("class_row").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(F.col("x.row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(docs.columns)
