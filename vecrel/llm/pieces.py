"""SentencePiece encoding and decoding over a relational lattice.

A text becomes the pieces that the model's own encoder finds.  Spaces turn into U+2581
after one more is put in front; the text is then cut into words where no piece can
cross: between characters that stand side by side in no piece.

The words are encoded once each: substrings of bounded length are exploded, equi-joined
to the piece table, the edges grouped by word, and a Viterbi fold runs over them with
Spark's higher-order ``aggregate``.  Characters without a piece cost the least score
less 10 and are spelled by byte pieces.  Of equal sums the split whose last piece
starts first wins.

Where the model's scores rank merges, the greatest sum alone is not the encoder's
split, so one more relation takes part: pairs of pieces that merging their characters
does not leave side by side.  An edge behind such a neighbour is void in the fold.  The
encoder's split of a word is then the one path that is left (each of its prefixes is
split the same way, and neighbours decide whether a boundary holds).

The piece table is bounded by the vocabulary.  The relational lattice encodes the
``TABLE_WORDS`` most frequent words of up to ``TABLE_CHARS`` characters (documented
parameters), which make up most occurrences, and only this bounded table is sent to the
tasks that assemble the texts.  Those encode the remaining words where they stand, by
the same lattice over the same piece table: moving each text or each rare word would
take more disk than the input.  Texts stay in their rows; nothing is shuffled but words.

Edge cases: a null text gives null ids, an empty one no ids.  Spaces of any number, line
breaks, control characters and characters outside the vocabulary come back exactly; the
mark U+2581 itself comes back as a space, as with the model's own decoder.  Repeated rows
are encoded each on its own; other columns are kept, but a column named ``ids`` (for
``decode``: ``decoded``) is replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
TABLE_WORDS, TABLE_CHARS = 200_000, 32
UNKNOWN = 10.0


@dataclass
class Pieces:
    ids: dict[str, int]
    scores: list[float]
    text: list[str]  # of each piece; '' for control pieces
    byte: list[int]  # of each piece, -1 where it is not a byte
    of_byte: list[int]
    unknown_id: int
    longest: int
    merging: bool  # whether scores rank merges
    edges: dict[str, int] = field(default_factory=dict)  # pieces that can be in a split
    apart: dict[int, bool] = field(default_factory=dict)  # by pair: whether it stays a pair
    ends: dict[str, int] = field(default_factory=dict)  # every ending of a piece, with its id where it is one
    unknown: float = 0.0
    made: Cutter | None = None

    def __post_init__(self) -> None:
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN
        self.edges = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merge(t) == [t]} if self.merging else self.ids
        self.ends = {t[k:]: -1 for t in self.edges for k in range(len(t))} | self.edges

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text, the pair of best score first, then the leftmost."""
        out = list(text)
        while len(out) > 1:
            best, at = -np.inf, -1
            for k in range(len(out) - 1):
                i = self.ids.get(out[k] + out[k + 1], -1)
                if i >= 0 and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def stays(self, a: int, b: int) -> bool:
        """Whether two pieces can stand side by side; unknown ones (negative) always can."""
        if not self.merging or a < 0 or b < 0:
            return True
        known = self.apart.get(a << 20 | b)
        if known is None:
            known = self.apart[a << 20 | b] = self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
            if len(self.apart) > 2_000_000:
                self.apart.clear()
        return known

    def cutter(self) -> Cutter:
        """Made once for each worker."""
        if self.made is None:
            self.made = Cutter(self.ids)
        return self.made


class Cutter:
    """Cuts marked texts into words, between characters that stand side by side in no piece."""

    def __init__(self, ids: dict[str, int]):
        chars = sorted(set("".join(ids)))
        self.place = np.zeros(0x110000, np.uint16)  # 0: a character that no piece holds
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        places = self.place[_codes("".join(ids))].astype(np.int64)
        last = np.cumsum([len(t) for t in ids]) - 1
        pairs = np.ones(len(places), bool)
        pairs[last] = False
        at = np.flatnonzero(pairs)
        self.beside[places[at], places[at + 1]] = True

    def cut(self, texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Marked texts in a row, starts, ends and hashes of their words, and how many each text has; about CHUNK_BYTES characters at a time."""
        lo = 0
        while lo < len(texts):
            own, size = [], 0
            while lo < len(texts) and (not own or size + len(texts[lo] or "") <= C.CHUNK_BYTES):
                own.append(marked(texts[lo] or ""))
                size += len(own[-1])
                lo += 1
            joined = "".join(own)
            codes = _codes(joined)
            first = np.cumsum([0, *map(len, own)])
            cut = np.ones(len(codes), bool)
            places = self.place[codes]
            cut[1:] = ~self.beside[places[:-1], places[1:]]
            cut[first[:-1][first[:-1] < len(codes)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(codes)) if len(starts) else starts
            yield joined, starts, ends, _hashes(codes, starts, ends), np.diff(np.searchsorted(starts, first))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(C.mix(codes.astype(np.uint64) + np.uint64(1)) * C.powers(len(codes) + 1)[0][: len(codes)], out=prefix[1:])
    return C.spans_hash(prefix, starts, ends)


def hashed(words: list[str]) -> np.ndarray:
    """The hashes of words as ``Cutter.cut`` gives them."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(words), 50_000):
        own = words[lo : lo + 50_000]
        ends = np.cumsum(list(map(len, own)))
        out.append(_hashes(_codes("".join(own)), np.concatenate([[0], ends[:-1]]), ends))
    return np.concatenate(out)


def load(path: str = MODEL) -> Pieces:
    """The piece table of a model file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    text = [model.id_to_piece(i) for i in range(n)]
    byte = [int(t[3:5], 16) if model.is_byte(i) else -1 for i, t in enumerate(text)]
    of_byte = [model.unk_id()] * 256
    for i, b in enumerate(byte):
        if b >= 0:
            of_byte[b] = i
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    ids = {t: i for i, t in enumerate(text) if plain[i]}
    return Pieces(ids, [model.get_score(i) for i in range(n)], [t if plain[i] else "" for i, t in enumerate(text)], byte, of_byte, model.unk_id(), max(map(len, ids)), proto.trainer_spec.model_type == proto.trainer_spec.BPE)


def encode_words(pieces: Pieces, words: list[str]) -> Iterator[list[int]]:
    """The lattices of the words, folded where they stand; where scores rank merges, a word keeps what it shares with the one before."""
    back, last, before = [(0, -1)], [-1], ""
    for word in words:
        if pieces.merging:
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del back[n + 1 :], last[n + 1 :]
            _merging_path(pieces, word, back, last)
            before = word
        else:
            back = _best_path(pieces, word)
        n, out = len(word), []
        while n:
            start, piece = back[n]
            out += [piece] if piece >= 0 else [pieces.of_byte[b] for b in reversed(word[start:n].encode(errors="replace"))]
            n = start
        yield out[::-1]


def _merging_path(pieces: Pieces, word: str, back: list[tuple[int, int]], last: list[int]) -> None:
    """Add the one edge into each further place that its neighbour lets stand; edges grow leftward while they end some piece."""
    get, apart, stays_of = pieces.ends.get, pieces.apart.get, pieces.stays
    for stop in range(len(back), len(word) + 1):
        edge = (stop - 1, -1)  # a character without a piece, unless an edge stands
        for start in range(stop - 1, -1, -1):
            piece = get(word[start:stop])
            if piece is None:
                break
            if piece >= 0:
                before = last[start]
                stays = True if before < 0 else apart(before << 20 | piece)
                if stays or (stays is None and stays_of(before, piece)):
                    edge = (start, piece)
                    break
        back.append(edge)
        last.append(edge[1])


def _best_path(pieces: Pieces, word: str) -> list[tuple[int, int]]:
    """The edge of the best sum of scores into each place."""
    n = len(word)
    best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
    ids, scores, unknown = pieces.edges, pieces.scores, pieces.unknown
    for start in range(n):
        here = best[start]
        for stop in range(start + 1, min(n, start + pieces.longest) + 1):
            piece = ids.get(word[start:stop], -1)
            if piece >= 0:
                score = here + scores[piece]
            elif stop == start + 1:
                score = here + unknown
            else:
                continue
            if score > best[stop]:
                best[stop], back[stop] = score, (start, piece)
    return back


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def count_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) of all texts of (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = shared.value.cutter()
        held: Counter[str] = Counter()
        for batch in batches:
            for joined, starts, ends, hashes, _ in cutter.cut(batch.column(0).to_pylist()):
                _, at, n = np.unique(hashes, return_index=True, return_counts=True)
                for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                    held[joined[a:b]] += k
            if len(held) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = TABLE_WORDS, chars: int = TABLE_CHARS) -> DataFrame:
    """The words of greatest count, at most ``most``: those above a count at which they fit."""
    short = counts.where(F.length("word") <= chars)
    histogram = short.groupBy(F.floor(4 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, words = 2**62, 0
    for row in histogram:
        words += row.words
        if words > most:
            break
        least = row.least
    return short.where(F.col("n") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) by exploded substrings, an equi-join to the piece table, and a Viterbi fold over the grouped edges."""
    spark: SparkSession = words.sparkSession
    table = spark.createDataFrame([(t, i, float(pieces.scores[i])) for t, i in pieces.edges.items()], "piece string, id int, score double")
    spelled = words.select("word", F.explode(F.expr(
        f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({pieces.longest}, length(word) - i + 1)), n -> struct(i - 1 AS start, i - 1 + n AS stop, substring(word, i, n) AS piece))))"
    )).alias("e")).select("word", "e.*")
    edges = spelled.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR stop = start + 1")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("stop", "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(pieces.unknown)).alias("score")))).alias("edges"))
    if pieces.merging:
        grouped = _with_void(grouped, pieces)
    else:
        grouped = grouped.withColumn("void", F.expr("cast(array() AS array<bigint>)"))
    # The state is one (score, start, id) for each place reached so far, place 0 first; edges come by stop, then start.
    folded = grouped.withColumn("back", F.expr("""
        aggregate(edges, array(named_struct('score', 0D, 'start', -1, 'id', -1)), (s, e) ->
            transform(array(IF(array_contains(void, s[e.start].id * 1048576L + e.id), double('-Infinity'), s[e.start].score + e.score)), score ->
                CASE WHEN size(s) <= e.stop THEN concat(s, array(named_struct('score', score, 'start', e.start, 'id', e.id)))
                     WHEN score > s[e.stop].score THEN concat(slice(s, 1, e.stop), array(named_struct('score', score, 'start', e.start, 'id', e.id)))
                     ELSE s END)[0])"""))  # fmt: skip
    path = folded.withColumn("path", F.expr("""
        aggregate(sequence(1, length(word)), named_struct('at', length(word), 'out', array(named_struct('start', 0, 'stop', 0, 'id', -2))), (p, i) ->
            IF(p.at = 0, p, named_struct('at', back[p.at].start, 'out', concat(array(named_struct('start', back[p.at].start, 'stop', p.at, 'id', back[p.at].id)), p.out)))).out"""))  # fmt: skip
    bytes_ = F.array(*[F.lit(i) for i in pieces.of_byte])
    return path.withColumn("of_byte", bytes_).select("word", F.expr("""
        flatten(transform(filter(path, p -> p.id > -2), p -> IF(p.id >= 0, array(p.id),
            transform(sequence(1, octet_length(substring(word, p.start + 1, p.stop - p.start))),
                      i -> of_byte[cast(conv(substring(hex(substring(word, p.start + 1, p.stop - p.start)), 2 * i - 1, 2), 16, 10) AS int)]))))""").alias("ids"))  # fmt: skip


def _with_void(grouped: DataFrame, pieces: Pieces) -> DataFrame:
    """With ``void``: the pairs of neighbouring edges of the word (first * 2^20 + second) that cannot stand side by side."""
    grouped = C.written(grouped, "piece-edges")
    shared = grouped.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = shared.value.stays
        for batch in batches:
            codes = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([c for c in codes if not stays(c >> 20, c & 0xFFFFF)], pa.int64())], ["code"])

    pairs = grouped.select("word", F.explode(F.expr(
        "array_distinct(flatten(transform(filter(edges, a -> a.id >= 0), a -> transform(filter(edges, b -> b.start = a.stop AND b.id >= 0), b -> a.id * 1048576L + b.id))))"
    )).alias("code"))
    void = pairs.select("code").distinct().mapInArrow(run, "code long")
    found = pairs.join(void, "code").groupBy("word").agg(F.collect_list("code").alias("void"))
    return grouped.join(found, "word", "left").withColumn("void", F.coalesce("void", F.expr("cast(array() AS array<bigint>)")))


class _Words:
    """Hash of a word to its place in a list of encoded words; a missing one is encoded and added.

    Added words are forgotten between chunks once there are ``MOST`` of them.
    """

    MOST = 300_000

    def __init__(self, pieces: Pieces, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray):
        """``keys``: sorted hashes of the table's words; ``flat``: their ids in a row; ``sizes``: how many each has."""
        self.pieces, self.keys, self.flat, self.sizes = pieces, keys, flat, sizes
        self.first = np.cumsum(sizes) - sizes
        self._forget()

    def _forget(self) -> None:
        self.added: dict[int, int] = {}
        self.coded: list[int] = []
        self.ends = [0]

    def _places(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each word."""
        kinds, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        known = self.keys[found] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
        first, size = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        first[known], size[known] = self.first[found[known]], self.sizes[found[known]]
        new = np.flatnonzero(~known)
        missing = sorted((joined[a:b], h) for a, b, h in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), kinds[new].tolist(), strict=True) if h not in self.added)
        for (_, h), ids in zip(missing, encode_words(self.pieces, [w for w, _ in missing]), strict=True):
            self.added[h] = len(self.added)
            self.coded += ids
            self.ends.append(len(self.coded))
        own, places = np.array(self.ends), np.array([self.added[h] for h in kinds[new].tolist()], np.int64)
        first[new], size[new] = len(self.flat) + own[places], own[places + 1] - own[places]
        return first[back], size[back]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        out, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for joined, starts, ends, hashes, words in self.pieces.cutter().cut(texts):
            first, size = self._places(joined, starts, ends, hashes)
            total = np.cumsum(size)
            flat = np.concatenate([self.flat, np.array(self.coded, np.int32)])
            out.append(flat[np.repeat(first - total + size, size) + np.arange(size.sum())])
            counts.append(np.diff(np.concatenate([[0], total])[np.cumsum(words)], prepend=0))
            if len(self.added) > self.MOST:
                self._forget()
        return np.concatenate(out), np.concatenate(counts)


def _shared_words(docs: DataFrame, pieces: Pieces, table_words: int):
    """Broadcast of the piece table and the encoded frequent words: at most ``table_words`` of them."""
    counted = C.written(count_words(docs, pieces), "piece-words")
    words = C.written(frequent(counted, table_words), "piece-frequent")
    coded = C.written(lattice(words, pieces), "piece-lattice")
    table = packed(coded)
    C.free(counted, words, coded)
    return docs.sparkSession.sparkContext.broadcast((pieces, *table))


def packed(coded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the words of (word, ids), their ids in a row and how many each has; tasks pack them, so that the driver has no objects for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().astype(np.int32)
            sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (hashed(batch.column(0).to_pylist()), flat, sizes)], ["keys", "flat", "sizes"])

    rows = coded.select("word", "ids").mapInArrow(run, "keys binary, flat binary, sizes binary").collect()
    keys, flat, sizes = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in enumerate((np.uint64, np.int32, np.int64)))
    by = np.argsort(keys)
    first, own = (np.cumsum(sizes) - sizes)[by], sizes[by]
    return keys[by], flat[np.repeat(first - np.cumsum(own) + own, own) + np.arange(len(flat))], own


def encode(docs: DataFrame, path: str = MODEL, table_words: int = TABLE_WORDS) -> DataFrame:
    """The columns of ``docs`` and ``ids``, the pieces of its text."""
    C.short_batches(docs.sparkSession)
    docs = docs.drop("ids")
    shared = _shared_words(docs, load(path), table_words)
    at, schema = len(docs.columns), docs.schema
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(*shared.value)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            ids, counts = table.encode(texts)
            lists = C.list_array(pa.array(ids), counts)
            if None in texts:
                lists = pa.array([None if x is None else y for x, y in zip(texts, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists], [*batch.schema.names[:at], "ids"])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def spellings(pieces: Pieces) -> list[bytes]:
    return [bytes([b]) if b >= 0 else t.encode() for b, t in zip(pieces.byte, pieces.text, strict=True)]


def decode_ids(spelled: list[bytes], ids: np.ndarray) -> str:
    """The text that ids spell."""
    text = b"".join([spelled[i] for i in ids.tolist()]).decode(errors="replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ids spell."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(spellings(load(path)))
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(shared.value, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(docs: DataFrame, path: str = MODEL, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, exact): the number of pieces, a digest of the ids, whether decoding gives the text back.

    Encodes, decodes and hashes in one Python stage, so a task holds one worker.
    """
    C.short_batches(docs.sparkSession)
    shared = _shared_words(docs, load(path), table_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(*shared.value)
        spelled = spellings(table.pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, counts = table.encode(texts)
            ends = np.cumsum(counts)
            own = [None if t is None else ids[e - n : e] for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([None if x is None else len(x) for x in own], pa.int32()), pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], pa.string()),
                    pa.array([x is None or decode_ids(spelled, x) == t for x, t in zip(own, texts, strict=True)]),
                ],
                ["doc_id", "n_pieces", "ids_sha256", "exact"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces int, ids_sha256 string, exact boolean")
