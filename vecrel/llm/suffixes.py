"""Exact removal of repeated byte strings, by a common-prefix-aware distributed merge sort.

Every byte covered by a string of ``match`` bytes that also starts anywhere else goes.
Not all suffixes are sorted.  Each window of ``match`` bytes has one anchor, the leftmost
least hash among its ``seed``-byte strings, which depends on the window's bytes alone:
equal windows have equal anchors at equal places.  Windows that share an anchor form a
stretch of text, and

* an anchor whose seed occurs once in the corpus has no repeated window,
* a stretch that occurs twice as a whole is repeated as a whole,
* of the others, and one copy of each repeated stretch with such a seed, the suffix from
  the anchor and the bytes before it are exchanged.  Each task sorts its suffixes into
  runs and front-codes them (length shared with the suffix before, and the rest).  The
  receiving task merges the runs with a loser tree that keeps the prefix length each
  loser shares with the winner, so known prefixes are never compared again, and gets the
  common prefixes of neighbours.  Walking up these prefixes from the longest, it keeps the
  bytes before the anchors of each group in order, from the smaller group into the larger;
  the greatest common extension to the left is at a neighbour.  Left and right extension
  of ``match`` bytes or more together are a repeat, and all repeats are found so.

Counts are 64-bit hashes of seeds and stretches; the merge compares bytes.  A seed with more
than ``CROWD`` distinct surroundings (one line in a great many documents) would make one long
merge; the windows around such seeds are counted by their hashes instead, in many tasks.

Edge cases: a null text counts as empty; texts shorter than ``match`` keep all bytes.
Overlapping occurrences count, within a document too.  Repeated rows are repeats of each
other.  Very long texts are read in overlapping pieces.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MATCH, SEED = 400, 128
#: Windows of one piece; places within a piece take 20 bits of a packed hash.
PIECE = 1 << 19
#: Suffixes that a merging task gets on average, and the most that one seed may bring.
PART, CROWD = 20_000, 10_000
#: Length of strings, and of seeds, that finds passages of over 50 words of four bytes.
PASSAGE, PASSAGE_SEED = 200, 64
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash of the seed, hash of the stretch); places within the texts."""
    width = match - seed + 1
    found = []
    stop = np.repeat(offsets[1:], np.diff(offsets))
    for base in range(0, max(0, len(data) - match + 1), PIECE):
        part = data[base : base + PIECE + match - 1]
        prefix = C.prefix_hash(part)
        grams = C.mix((prefix[seed:] - prefix[:-seed]) * C.powers(len(prefix))[1][: len(prefix) - seed])
        packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        n = len(grams) - width + 1
        blocks = np.full(-(-len(grams) // width) * width, np.uint64(2**64 - 1))
        blocks[: len(grams)] = packed
        blocks = blocks.reshape(-1, width)
        forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        at = (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        windows = np.flatnonzero(np.arange(n) + base + match <= stop[base : base + n])
        if not len(windows):
            continue
        at = at[windows]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        lo, hi, at = windows[first], windows[np.append(first[1:], len(windows)) - 1], at[first]
        whole = C.mix(C.spans_hash(prefix, lo, hi + match) + (at - lo).astype(np.uint64))
        text = np.searchsorted(offsets, lo + base, "right") - 1
        shift = base - offsets[text]
        found.append((text, at + shift, lo + shift, hi + shift, grams[at], whole))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shared_length(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    n, step = min(len(a), len(b)), 8
    while start < n:
        stop = min(start + step, n)
        if a[start:stop] != b[start:stop]:
            while stop - start > 1:
                middle = (start + stop) // 2
                if a[start:middle] == b[start:middle]:
                    start = middle
                else:
                    stop = middle
            return start
        start, step = stop, 2 * step
    return n


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Length shared with the string before and the rest, of sorted strings."""
    shared = [0, *(shared_length(a, b) for a, b in zip(strings, strings[1:], strict=False))] if strings else []
    return shared, [s[n:] for n, s in zip(shared, strings, strict=True)]


def decode(shared: list[int], rests: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    for n, rest in zip(shared, rests, strict=True):
        out.append((out[-1][:n] if n else b"") + rest)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, length shared with the string before) over sorted runs with their shared lengths, in order.

    A loser tree: each inner node keeps the loser of its match, and each run the length its
    head shares with the last winner it lost to or followed.  Of two heads that lost to
    the same string, the one sharing more with it is the smaller, without comparison; only
    heads that share equally much are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    place = [0] * len(runs)
    shared = [0] * len(runs)

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; -1 is a run that has ended."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = runs[a][0][place[a]], runs[b][0][place[b]]
        n = shared_length(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            if n == len(y) and b < a:
                a, b = b, a
        else:
            a, b = b, a
        shared[b] = n
        return a, b

    losers = [-1] * size
    level = [r if r < len(runs) and runs[r][0] else -1 for r in range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for k in range(0, len(level), 2):
            winner, losers[node + k // 2] = match(level[k], level[k + 1])
            up.append(winner)
        level = up
    winner = level[0] if level else -1
    while winner >= 0:
        yield winner, place[winner], shared[winner]
        run = winner
        place[run] += 1
        head = run
        if place[run] < len(runs[run][0]):
            shared[run] = runs[run][1][place[run]]
        else:
            head = -1
        node = (size + run) // 2
        while node:
            head, losers[node] = match(head, losers[node])
            node //= 2
        winner = head


def repeats(shared: list[int], before: list[bytes], match: int) -> list[list[tuple[int, int]]]:
    """For sorted suffixes: (left, right) extensions of ``match`` bytes or more together, enough to cover all repeats of each.

    ``shared``: prefix lengths of neighbours; ``before``: the bytes before each, reversed.
    """
    n = len(before)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    group = [[(before[i], i)] for i in range(n)]
    name = list(range(n))

    def root(x: int) -> int:
        while name[x] != x:
            name[x] = name[name[x]]
            x = name[x]
        return x

    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        a, b, right = root(i - 1), root(i), shared[i]
        if len(group[a]) < len(group[b]):
            a, b = b, a
        large = group[a]
        for entry in group[b]:
            at = bisect_left(large, entry)
            for other in large[max(0, at - 1) : at + 1]:
                left = shared_length(entry[0], other[0])
                if left + right >= match:
                    out[entry[1]].append((left, right))
                    out[other[1]].append((left, right))
            large.insert(at, entry)
        group[b] = []
        name[b] = a
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _anchored(docs: DataFrame, match: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            for lo, _, part, off in C.groups(data, offsets, PIECE):
                text, at, first, last, gram, whole = anchors(part, off, match, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + lo)), *(pa.array(x) for x in (at, first, last, gram.view(np.int64), whole.view(np.int64)))], ["row", "at", "first", "last", "seed", "whole"]
                )

    return docs.select("row", "text").mapInArrow(run, "row long, at long, first long, last long, seed long, whole long")


_RUNS = "part int, run long, place int, shared int, rest binary, before binary, row long, at long, wanted boolean"


def _sorted_runs(df: DataFrame, match: int, seed: int) -> DataFrame:
    """Front-coded sorted runs, one for each batch and part, of (text, row, anchors of (at, part, wanted))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        for number, batch in enumerate(batches):
            by: dict[int, list[tuple]] = {}
            texts, rows, lists = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, own in enumerate(lists):
                text = texts[i].as_buffer().to_pybytes()
                for x in own:
                    at = x["at"]
                    by.setdefault(x["part"], []).append((text[at : at + match], text[max(0, at - match + seed) : at][::-1], rows[i], at, x["wanted"]))
            name = (context.partitionId() << 24) + number
            for part, own in by.items():
                own.sort()
                shared, rests = front_code([x[0] for x in own])
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, name, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(shared, pa.int32()), pa.array(rests, pa.binary()),
                        *(pa.array([x[k] for x in own], kind) for k, kind in ((1, pa.binary()), (2, pa.int64()), (3, pa.int64()), (4, pa.bool_()))),
                    ],
                    ["part", "run", "place", "shared", "rest", "before", "row", "at", "wanted"],
                )

    return df.mapInArrow(run, _RUNS)


def _merged(runs: DataFrame, match: int, seed: int) -> DataFrame:
    """(row, start, stop) of the repeats of the wanted anchors."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["run", "place"], kind="stable").reset_index(drop=True)
        begin = np.flatnonzero((pdf.run != pdf.run.shift()).to_numpy())
        shared, rests = pdf.shared.tolist(), pdf.rest.tolist()
        coded = [(decode(shared[a:b], rests[a:b]), shared[a:b]) for a, b in zip(begin, [*begin[1:], len(pdf)], strict=True)]
        before, rows, at, wanted = pdf.before.tolist(), pdf.row.tolist(), pdf["at"].tolist(), pdf.wanted.tolist()
        out: list[tuple[int, int, int]] = []
        group: list[int] = []
        lengths: list[int] = []

        def close() -> None:
            if len(group) > 1 and any(wanted[i] for i in group):
                for i, pairs in zip(group, repeats(lengths, [before[i] for i in group], match), strict=True):
                    if wanted[i] and pairs:
                        out.extend((rows[i], lo, hi) for lo, hi in union([(at[i] - a, at[i] + b) for a, b in pairs]))
            group.clear()
            lengths.clear()

        for run, place, length in merge_runs(coded):
            if length < seed:
                close()
            group.append(int(begin[run]) + place)
            lengths.append(length)
        close()
        return pd.DataFrame(out, columns=["row", "start", "stop"]).astype("int64")

    return runs.groupBy("part").applyInPandas(merge, "row long, start long, stop long")


def spans(docs: DataFrame, match: int = MATCH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """(row, start, stop) of repeated bytes of (row, text); spans of a row may overlap."""
    seen = C.written(_anchored(docs, match, seed), "suffix-anchors")
    total = seen.count()
    twice = C.written(seen.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "suffix-seeds")
    live = C.written(C.having(seen, twice, ["seed"], total), "suffix-live")
    C.free(seen, twice)
    stretch = C.written(live.groupBy("seed", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("one")), "suffix-stretches")
    again = C.having(live, stretch.where("n > 1"), ["seed", "whole"], total)
    out = C.written(again.select("row", F.col("first").alias("start"), (F.col("last") + match).alias("stop")), "suffix-whole")
    C.free(live)
    mixed = stretch.groupBy("seed").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("n > 1 AND least = 1")
    one = stretch.select("seed", F.col("n").alias("copies"), "one.*")
    picked = C.written(C.having(one, mixed, ["seed"], total).select("seed", "row", "at", "first", "last", (F.col("copies") == 1).alias("wanted")), "suffix-picked")
    crowds = C.written(picked.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "suffix-crowds")  # a share of 1 / crowd of the rows at most
    if crowds.isEmpty():
        few = picked
    else:
        few = picked.join(crowds, "seed", "left_anti")
        out = out.unionByName(_counted(docs, C.having(picked, crowds, ["seed"], total), match))
    # An anchor of a very long text may have several stretches, cut by the pieces; it is one suffix.
    suffixes = C.written(few.groupBy("seed", "row", "at").agg(F.max("wanted").alias("wanted")), "suffix-few")
    parts = max(1, -(-suffixes.count() // PART))
    by_row = suffixes.groupBy("row").agg(F.collect_list(F.struct("at", F.pmod(F.xxhash64("seed"), F.lit(parts)).cast("int").alias("part"), "wanted")).alias("anchors"))
    runs = _sorted_runs(docs.join(by_row, "row").select("text", "row", "anchors"), match, seed)
    out = out.unionByName(C.written(_merged(runs, match, seed), "suffix-merged"))
    C.free(stretch, picked, crowds, suffixes)
    return out


def _counted(docs: DataFrame, stretches: DataFrame, match: int) -> DataFrame:
    """(row, start, stop) of the windows of the stretches (row, first, last) that occur in two of them, by hash."""
    listed = stretches.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            lists, rows = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for lo, hi, part, off in C.groups(data, offsets):
                prefix = C.prefix_hash(part)
                for i in range(lo, hi):
                    own = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in lists[i]]))
                    found = C.spans_hash(prefix, own + off[i - lo], own + off[i - lo] + match)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rows[i])), pa.array(own), pa.array(found.view(np.int64))], ["row", "start", "window"])

    windows = C.written(docs.join(listed, "row").select("row", "text", "own").mapInArrow(run, "row long, start long, window long"), "suffix-windows")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
    out = C.having(windows, again, ["window"], windows.count()).select("row", "start", (F.col("start") + match).alias("stop"))
    out = C.written(out, "suffix-counted")
    C.free(windows)
    return out


def _kept(text: bytes, own: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text without its spans, and the number of maximal spans."""
    joined = union([(x["start"], x["stop"]) for x in own or []])
    edges = [0, *(e for s in joined for e in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(joined)


def _listed(found: DataFrame, row: str = "row", spans: str = "spans") -> DataFrame:
    return found.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start", "stop", "short")).alias(spans))


def report(docs: DataFrame, match: int = MATCH, seed: int = SEED, passage: tuple[int, int] | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated) for every row of (doc_id, text).

    ``n_repeated``: with a ``passage`` (length and seed), the bytes in repeated strings of that
    length, which are looked for beside those that are removed; without one, ``n_removed``.
    """
    C.short_batches(docs.sparkSession)
    rows = C.stable(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spans(rows.select("row", "text"), match, seed, crowd).withColumn("short", F.lit(False))
    if passage:
        found = found.unionByName(spans(rows.select("row", "text"), *passage, crowd).withColumn("short", F.lit(True)))
    joined = rows.join(_listed(found), "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            raw, out = data.tobytes(), []
            for i, own in enumerate(batch.column(2).to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                kept, n = _kept(text, [x for x in own or [] if not x["short"]])
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), len(text) - len(_kept(text, own)[0])))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def remove(docs: DataFrame, match: int = MATCH, seed: int = SEED) -> DataFrame:
    """The documents with repeated bytes removed (a character cut in two goes whole) and n_chars, if there, anew; other columns as they were."""
    C.short_batches(docs.sparkSession)
    docs = C.stable(docs)
    row = C.fresh(docs, "row")
    found = C.fresh(docs, "spans")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    listed = _listed(spans(texts, match, seed).withColumn("short", F.lit(False)), row, found)
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(listed, row, "left").select(*docs.columns, found)
    schema, names, at = docs.schema, docs.columns, docs.columns.index("text")
    chars = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            texts, sizes = columns[at].to_pylist(), columns[chars].to_pylist() if chars >= 0 else []
            for i, own in enumerate(batch.column(len(names)).to_pylist()):
                if own:
                    texts[i] = _kept(texts[i].encode(), own)[0].decode(errors="ignore")
                    if chars >= 0:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if chars >= 0:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)
