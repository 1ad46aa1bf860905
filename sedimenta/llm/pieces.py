"""SentencePiece encoding by a relational lattice, and decoding."""

from __future__ import annotations

import pickle
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import id_and_text, packed, slices
from .tokens import SPACE, PrefixCounter, segment_form

#: Text of one bundle, text whose words are folded together, and text whose words one
#: lattice task works on.
BUNDLE_BYTES, REGION_BYTES, PART_BYTES = 48 << 20, 2 << 30, 4 << 20
#: Slots of words for each lattice task; words that one blob of packed words may hold.
SLOTS, BLOB_WORDS = 4, 200_000
#: How much worse than the worst piece a character without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Characters of a word whose lattice is folded in a row (a bit for each border).
LONGEST_WORD = 60
#: Words whose place a task keeps at hand.
WORDS_KEPT = 100_000


class Vocabulary:
    """What a SentencePiece file says about its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        self.byte_ids = {int(library.id_to_piece(i)[3:5], 16): i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        silent = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
        self.pieces = {i: library.id_to_piece(i) for i in ids if not any(kind(i) for kind in silent)}
        self.scores = {i: float(library.get_score(i)) for i in self.pieces}
        self.form = segment_form(self.pieces.values())
        self.inner = {piece[i : i + 2] for piece in self.pieces.values() for i in range(len(piece) - 1)}
        self.by_merges = all(score.is_integer() for score in self.scores.values())  # ranks of merges
        self.model, self.counter = model, None

    def segments(self, text: str) -> list[str]:
        """The marked text in segments that no piece reaches out of."""
        found = self.form.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if any(len(x) > LONGEST_WORD for x in found):
            found = [y for x in found for y in (self.cut(x) if len(x) > LONGEST_WORD else (x,))]
        return found

    def cut(self, segment: str) -> list[str]:
        """Cuts wherever no piece holds the two characters side by side."""
        at = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.inner), len(segment)]
        return [segment[a:b] for a, b in zip(at, at[1:])]

    def long(self, word: str) -> list[int]:
        """Pieces of a word that is too long for a lattice row."""
        if not self.by_merges:
            return viterbi(word, self)
        self.counter = self.counter or PrefixCounter(self.model)
        ids = {piece: i for i, piece in self.pieces.items()}
        return self.expanded([ids.get(token, -1 - ord(token[0])) for token in self.counter.tokens(word)])

    def expanded(self, ids: list[int]) -> list[int]:
        """Replaces -1 - c, a character c without a piece, by its bytes' ids."""
        out = []
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids.get(b, self.unknown) for b in chr(-1 - i).encode()]
        return out

    def decoded(self, ids: list[int], bytes_of: dict[int, bytes]) -> str:
        text = b"".join(map(bytes_of.get, ids, repeat(b""))).decode(errors="replace").replace(SPACE, " ")
        return text.removeprefix(" ")

    def bytes_of(self) -> dict[int, bytes]:
        return {i: piece.encode() for i, piece in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """``piece``, ``piece_id``, ``score``: as many rows as the vocabulary has pieces."""
    rows = [(piece, i, vocabulary.scores[i]) for i, piece in vocabulary.pieces.items()]
    return spark.createDataFrame(rows, "piece string, piece_id int, score double")


def reach_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """``head``, ``reach``: the longest piece that begins with these three characters."""
    reach: dict[str, int] = {}
    for piece in vocabulary.pieces.values():
        if len(piece) > 2:
            reach[piece[:3]] = max(len(piece), reach.get(piece[:3], 0))
    return spark.createDataFrame(list(reach.items()), "head string, reach int")


#: The two folds over a word's edges. Merges, for models whose scores are ranks of
#: merges: ``cuts`` has a bit for each border between symbols; again and again the best
#: edge that has exactly one cut inside loses it. Edges are sorted by rank and start;
#: those that lost an end, or have no cut left inside, are not looked at again.
MERGED = """
    transform(array_sort(filter(edges, edge ->
        (cuts & edge.ends) = edge.ends AND bit_count(cuts & edge.inside) = 0), (x, y) -> x.start - y.start),
        edge -> edge.id)
"""
CUTS = """
    aggregate(sequence(1, length),
        named_struct('cuts', shiftleft(1L, length + 1) - 1, 'live', filter(edges, edge -> edge.inside <> 0)),
        (state, step) -> IF(size(state.live) = 0, state, named_struct(
            'cuts', state.cuts & ~coalesce(get(filter(state.live, edge ->
                (state.cuts & edge.ends) = edge.ends AND bit_count(state.cuts & edge.inside) = 1), 0).inside, 0L),
            'live', filter(state.live, edge ->
                (state.cuts & edge.ends) = edge.ends AND (state.cuts & edge.inside) <> 0))),
        state -> state.cuts)
"""
#: Viterbi, for models whose scores are logarithms of probabilities: ``total[p]`` is the
#: best score up to position p, ``back[p]`` its last edge; on a tie the longer edge
#: stays. Edges are sorted by end and start. The second fold walks back.
FORWARD = """
    aggregate(edges,
        named_struct('total', array(0D), 'back', array(named_struct('start', 0, 'id', 0))),
        (path, edge) -> IF(
            edge.end = size(path.total),
            named_struct('total', array_append(path.total, path.total[edge.start] + edge.score),
                         'back', array_append(path.back, named_struct('start', edge.start, 'id', edge.id))),
            IF(path.total[edge.start] + edge.score > path.total[edge.end],
                named_struct('total', array_append(slice(path.total, 1, edge.end), path.total[edge.start] + edge.score),
                             'back', array_append(slice(path.back, 1, edge.end), named_struct('start', edge.start, 'id', edge.id))),
                path)),
        path -> path.back)
"""
BACKWARD = """
    reverse(aggregate(back,
        named_struct('at', size(back) - 1, 'ids', cast(array() AS array<int>)),
        (walk, _) -> IF(walk.at = 0, walk,
            named_struct('at', back[walk.at].start, 'ids', array_append(walk.ids, back[walk.at].id))),
        walk -> walk.ids))
"""


def encoded_words(words: DataFrame, table: DataFrame, reach: DataFrame, unknown_score: float, by_merges: bool) -> DataFrame:
    """Adds ``ids`` to rows of ``word`` (of ``LONGEST_WORD`` at most) and ``bundles``,
    each word once in each ``slot``.

    Substrings are exploded, from each start as far as a piece with the same first three
    characters reaches, and joined to the piece table. Both tables are bounded by the
    vocabulary and therefore broadcast; every character has an edge of its own besides.
    Edges are grouped by word and folded by a higher-order function; a word's bundles go
    with its first character only. A character c without a piece gets the id -1 - c.
    """
    starts = words.select("slot", "word", "bundles", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("start"))
    starts = starts.withColumn("head", F.expr("substring(word, start + 1, 3)")).join(F.broadcast(reach), "head", "left")
    lengths = F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(2)), F.char_length("word") - F.col("start")))
    ends = starts.select("slot", "word", "bundles", "start", F.explode(lengths).alias("length"))
    spans = ends.withColumn("piece", F.expr("substring(word, start + 1, length)"))
    edges = spans.join(F.broadcast(table), "piece", "left").where("length = 1 OR piece_id IS NOT NULL")
    bundles = F.when((F.col("start") == 0) & (F.col("length") == 1), F.col("bundles")).alias("bundles")
    number = F.coalesce("piece_id", -1 - F.ascii("piece")).alias("id")
    if by_merges:
        ends = F.expr("shiftleft(1L, start) | shiftleft(1L, start + length)").alias("ends")
        inside = F.expr("shiftleft(1L, start + length) - shiftleft(1L, start + 1)").alias("inside")
        edge = F.struct((-F.coalesce("score", F.lit(0.0))).alias("rank"), "start", ends, inside, number)
    else:
        edge = F.struct((F.col("start") + F.col("length")).alias("end"), "start", number, F.coalesce("score", F.lit(unknown_score)).alias("score"))
    edges = edges.select("slot", "word", bundles, edge.alias("edge"))
    lattices = edges.groupBy("slot", "word").agg(F.first("bundles", ignorenulls=True).alias("bundles"), F.array_sort(F.collect_list("edge")).alias("edges"))
    if by_merges:
        folded = lattices.select("word", "bundles", "edges", F.char_length("word").alias("length"))
        folded = folded.select("word", "bundles", "edges", F.expr(CUTS).alias("cuts"))
        return folded.select("word", "bundles", F.expr(MERGED).alias("ids"))
    folded = lattices.select("word", "bundles", F.expr(FORWARD).alias("back"))
    return folded.select("word", "bundles", F.expr(BACKWARD).alias("ids"))


class BundleWords:
    """The words of one bundle: hashes, numbers of pieces and pieces as flat arrays.

    A table of Python strings would take ten times the memory; names stay compressed and
    are only read again for words whose hashes are equal. Every word of a text of the
    bundle is here.
    """

    def __init__(self):
        self.parts: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]] = []
        self.named: dict[str, np.ndarray] = {}
        self.places: dict[str, int] = {}
        self.hashes, self.lengths = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    @staticmethod
    def hashed(words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def opened(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
        import zstandard

        return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))

    def add(self, blob: bytes) -> None:
        words, lengths, ids = self.opened(blob)
        self.parts.append((blob, self.hashed(words), lengths, ids))

    def close(self) -> None:
        """Sorts what was added, before the first text."""
        hashes = np.concatenate([x[1] for x in self.parts])
        lengths = np.concatenate([x[2] for x in self.parts])
        self.ids = np.concatenate([x[3] for x in self.parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.lengths = hashes[order], lengths[order]
        self.starts = (np.cumsum(lengths, dtype=np.int64) - lengths)[order]
        twice = self.hashes[1:][self.hashes[1:] == self.hashes[:-1]]
        for blob, own, sizes, ids in self.parts if len(twice) else ():
            ends = np.cumsum(sizes)
            clashing = np.flatnonzero(np.isin(own, twice))
            words = self.opened(blob)[0] if len(clashing) else []
            self.named |= {words[at]: ids[ends[at] - sizes[at] : ends[at]] for at in clashing}
        self.parts = []

    def encoded(self, words: list[str], vocabulary: Vocabulary) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.int32)
        if self.parts:
            self.close()
        places = list(map(self.places.get, words))
        odd: dict[int, np.ndarray] = {}
        if None in places:
            missing = [at for at, place in enumerate(places) if place is None]
            hashes = self.hashed([words[at] for at in missing])
            if len(self.places) > WORDS_KEPT:
                self.places.clear()
            for at, place in zip(missing, np.searchsorted(self.hashes, hashes).tolist()):
                word = words[at]
                if len(word) > LONGEST_WORD:
                    odd[at] = np.array(vocabulary.long(word), dtype=np.int32)
                elif word in self.named:
                    odd[at] = self.named[word]
                else:
                    places[at] = self.places[word] = place
        out, begin = [], 0
        for at in [*odd, len(words)]:
            if begin < at:
                out.append(self.plain(np.array(places[begin:at])))
            if at in odd:
                out.append(odd[at])
            begin = at + 1
        return out[0] if len(out) == 1 else np.concatenate(out)

    def plain(self, at: np.ndarray) -> np.ndarray:
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        place = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.ids[place]


def bundled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``id``, ``body`` and ``bundle``: neighbouring rows of a file, about
    ``BUNDLE_BYTES`` of text; and the bytes of all text. Rows that are not read from
    files are staged first."""
    try:
        rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        rows = stage(id_and_text(docs, id_col, text_col), "pieces-rows")
        rows = rows.select("id", "body", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()
    bundle_rows = max(1, int(size["n"] * BUNDLE_BYTES / max(1, size["bytes"])))
    bundle = F.hash("file", F.floor(F.col("row") / bundle_rows))
    return rows.select("id", "body", bundle.alias("bundle")), size["bytes"]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id`` and ``ids``, the pieces of the whole text; one row per input row.

    ``decoded`` adds ``text``, what the pieces give back, in the task that has them at
    hand: as ``decode`` of the result does, without a second process for each task and
    without the pieces passing through Spark and back.

    Segments that no piece of the model reaches out of ("words") are encoded once for
    a region of bundles of rows, see ``encoded_words``. A word returns to each bundle it
    came from, packed with others; the bundle's texts, compressed, meet its words in
    one task, which looks them up. So no word occurrence is shuffled, and as a region
    has a fixed number of bundles and of slots of words, what is packed grows in
    proportion to the table.

    Ids are those of the library: for a model whose scores are ranks of merges (BPE) the
    edges are folded by merging, for one with logarithms of probabilities (unigram) by
    Viterbi. Characters without a piece become their bytes. Words of over
    ``LONGEST_WORD`` characters are encoded by prefixes, as in ``tokens``, in the task
    that looks words up.

    Defined results: null and empty texts have no pieces. A literal word mark in a text
    counts as a space. Null ids, ties and repeated rows pass row by row; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(model)
    rows, n_bytes = bundled(docs, id_col, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // PART_BYTES + 1)
    regions = n_bytes // REGION_BYTES + 1
    kind = docs.schema[id_col].dataType.simpleString()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = defaultdict(set)
        for batch in slices(batches, "body"):
            for bundle, text in zip(batch.column("bundle").to_pylist(), batch.column("body").to_pylist()):
                seen[bundle].update(x for x in vocabulary.segments(text) if len(x) <= LONGEST_WORD)
            if sum(map(len, seen.values())) > 500_000:  # else one row for each word of a bundle and task
                yield from pairs(seen)
                seen.clear()
        yield from pairs(seen)

    def pairs(seen: dict[int, set[str]]) -> Iterator[pa.RecordBatch]:
        for bundle, found in seen.items():
            texts = list(found)
            for at in range(0, len(texts), 50_000):
                some = texts[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([bundle] * len(some), pa.int32())], ["word", "bundle"])

    found = rows.select("bundle", "body").mapInArrow(words, "word string, bundle int")
    slots = SLOTS * (parts // regions + 1)
    slot = F.pmod("bundle", F.lit(regions)) * slots + F.pmod(F.xxhash64("word"), F.lit(slots))
    distinct = found.withColumn("slot", slot).repartition(parts, "slot").groupBy("slot", "word").agg(F.collect_set("bundle").alias("bundles"))
    worst = min(vocabulary.scores.values()) - UNKNOWN_PENALTY
    known = encoded_words(distinct, piece_table(spark, vocabulary), reach_table(spark, vocabulary), worst, vocabulary.by_merges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        lists: dict[int, tuple[list[str], array, array]] = defaultdict(lambda: ([], array("i"), array("i")))
        held = 0

        def blobs() -> Iterator[pa.RecordBatch]:
            for bundle, (words, sizes, flat) in lists.items():
                lengths, ids = np.array(sizes, dtype=np.int32), np.array(flat, dtype=np.int32)
                order = np.array(sorted(range(len(words)), key=words.__getitem__))
                ends, sizes = np.cumsum(lengths), lengths[order]
                starts = np.cumsum(sizes) - sizes
                ids = ids[np.repeat(ends[order] - sizes - starts, sizes) + np.arange(len(ids))]
                blob = press.compress(pickle.dumps(([words[at] for at in order], sizes, ids)))
                yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int32()), pa.array([blob], pa.binary())], ["bundle", "packed"])

        for batch in batches:
            for word, bundles, ids in zip(*(batch.column(x).to_pylist() for x in ("word", "bundles", "ids"))):
                ids = vocabulary.expanded(ids)
                for bundle in bundles:  # flat arrays: an object for each word would take five times the memory
                    words, sizes, flat = lists[bundle]
                    words.append(word)
                    sizes.append(len(ids))
                    flat.extend(ids)
                held += len(bundles)
            if held > BLOB_WORDS:
                yield from blobs()
                lists.clear()
                held = 0
        yield from blobs()

    entries = known.mapInArrow(pack, "bundle int, packed binary").select("bundle", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), "packed")
    texts = packed(rows).select("bundle", F.lit(1).alias("kind"), "id", "packed")
    together = entries.unionByName(texts).repartition(parts, "bundle").sortWithinPartitions("bundle", "kind")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        known, current = BundleWords(), None
        bytes_of = vocabulary.bytes_of() if decoded else {}
        for batch in slices(batches, "packed", 1 << 20):
            ids, lists = [], []
            for bundle, is_text, row_id, blob in zip(*(batch.column(x).to_pylist() for x in ("bundle", "kind", "id", "packed"))):
                if bundle != current:
                    known, current = BundleWords(), bundle
                if is_text:
                    ids.append(row_id)
                    lists.append(known.encoded(vocabulary.segments(open_.decompress(blob).decode()), vocabulary))
                else:
                    known.add(blob)
            if lists:
                offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                columns = [pa.array(ids, batch.schema.field("id").type), pa.ListArray.from_arrays(offsets, np.concatenate(lists))]
                if decoded:
                    columns.append(pa.array([vocabulary.decoded(x.tolist(), bytes_of) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "text"][: len(columns)])

    return together.mapInArrow(look_up, f"id {kind}, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Adds ``text`` to rows with ``ids``: pieces and bytes joined, marks turned into
    spaces, the mark before the text taken away. Ids outside the vocabulary and control
    ids give nothing; null ids give the empty text. A column ``text`` is replaced."""
    vocabulary = Vocabulary(model)
    encoded = encoded.select(*(encoded[x] for x in encoded.columns if x.lower() != "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = vocabulary.bytes_of()
        for batch in slices(batches, "ids", 1 << 20):
            texts = [vocabulary.decoded(ids or [], bytes_of) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(text, f"{fields}, text string")


def viterbi(word: str, vocabulary: Vocabulary) -> list[int]:
    """The same path by a plain loop, as a statement of the rule."""
    ids = {piece: i for i, piece in vocabulary.pieces.items()}
    longest, worst = max(map(len, ids)), min(vocabulary.scores.values()) - UNKNOWN_PENALTY
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            i = ids.get(word[start:end])
            if i is not None or start == end - 1:
                score = vocabulary.scores[i] if i is not None else worst
                options.append((best[start][0] + score, -start, best[start][1] + [i if i is not None else -1 - ord(word[start])]))
        best.append(max(options, key=lambda x: x[:2])[::2])
    return vocabulary.expanded(best[-1][1])
