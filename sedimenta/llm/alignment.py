"""Alignment of two tokenizations by composing fragments of byte ranges."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .common import slices
from .tokens import SPACE

#: Bytes of a text's chunk, fragments composed in one step, and the most text that shares
#: one table of link counts.
CHUNK, FAN_IN, BUNDLE_BYTES = 1 << 16, 16, 48 << 20
#: Stretches between two borders whose tokens a worker keeps.
SEEN_ONCE, SEEN_TWICE = 90_000, 150_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand
    for themselves, the others follow from code point 256 on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


#: What is kept of a stretch that is not given back.
LOST = -1, -1, b"", b""


class Tokenizers:
    """Both libraries, the bytes of each token, and where texts may be cut."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        alphabet = byte_alphabet()
        added = {x["id"] for x in json.loads(first)["added_tokens"]}
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in each], dtype=np.int64) for each in (self.bytes_a, self.bytes_b))
        inner = {x[k : k + 2] for i, x in enumerate(pieces) if not self.second.is_byte(i) for k in range(len(x) - 1)}
        #: A border lies before white space that a word follows, where the first kind never
        #: goes on, if no piece holds a character and this white space behind it. (Runs of
        #: marks are no exception: a text with a mark is not given back.)
        self.blanks = "".join(c for c in " \n\t" if not any(x[1] == c.replace(" ", SPACE) and x != 2 * SPACE for x in inner))
        self.border = re.compile(rf"(?<=\S)(?=[{self.blanks}]\s*\S)" if self.blanks else "(?!)")
        self.writer = Writer(len(self.bytes_a), len(self.bytes_b))
        self.kept: dict[str, tuple[int, int, bytes, bytes]] = {}
        self.seen: dict[str, tuple[int, int, bytes, bytes]] = {}

    def borders(self, text: str) -> Iterator[int]:
        """Places where no token of either kind reaches across."""
        return (found.start() for found in self.border.finditer(text))

    def learn(self, parts: list[str]) -> None:
        """Encodes new stretches, many in one text: borders keep them apart there, too."""
        group: list[str] = []
        size = 0
        for part in parts:
            if part[-1].isspace() or part[0] not in self.blanks:
                self.learn_group([part])
                continue
            group.append(part)
            size += len(part)
            if size > 1 << 14:
                self.learn_group(group)
                group, size = [], 0
        if group:
            self.learn_group(group)

    def learn_group(self, group: list[str]) -> None:
        """Keeps numbers of tokens of both kinds, groups and links of each stretch."""
        if (ids := self.encoded("".join(group))) is None:
            if len(group) == 1:
                self.kept[group[0]] = LOST
            else:
                for part in group:
                    self.learn_group([part])
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = (a[at_a].astype(np.int64) << 32 | b[at_b].astype(np.int64)).tobytes()
        stops = np.cumsum([len(part.encode()) for part in group])
        tokens_a, tokens_b, cuts = (np.searchsorted(each, stops, side="right").tolist() for each in (ends_a, ends_b, ends_a[at_a]))
        shown = self.writer.tokens(a, b, at_a, at_b)
        from_a = from_b = from_cut = 0
        for part, to_a, to_b, to_cut in zip(group, tokens_a, tokens_b, cuts):
            text = "".join(shown[from_a + from_b : to_a + to_b])[:-1].encode()
            self.kept[part] = to_a - from_a, to_b - from_b, text, links[8 * from_cut : 8 * to_cut]
            from_a, from_b, from_cut = to_a, to_b, to_cut

    def stretches(self, texts: list[str]) -> Iterator[list[tuple[int, int, bytes, bytes]] | None]:
        """The stretches of each text, or None if one of them is not given back.

        Stretches that come a second time while they are among the ``SEEN_ONCE`` latest
        are kept longer than those that came once."""
        if len(self.seen) > SEEN_ONCE:
            self.seen.clear()
        if len(self.kept) > SEEN_TWICE:
            self.kept.clear()
        split, kept = self.border.split, self.kept
        parts = [split(text) if text and SPACE not in text else [] for text in texts]
        new = set(chain.from_iterable(parts)).difference(kept)
        again = new.intersection(self.seen)
        kept.update((part, self.seen.pop(part)) for part in again)
        new -= again
        self.learn(list(new))
        for text, each in zip(texts, parts):
            found = [kept[part] for part in each]
            yield None if SPACE in text or LOST in found else found
        for part in new:
            found = kept.pop(part)
            if len(part) <= 64:
                self.seen[part] = found

    def wholes(self, texts: list[str]) -> Iterator[Fragment]:
        """The fragments of whole texts: their stretches are closed on both sides."""
        for parts in self.stretches(texts):
            if parts is None:
                yield Fragment(sound=False)
                continue
            n_a, n_b, groups, links = zip(*parts) if parts else [()] * 4
            links = np.frombuffer(b"".join(links), dtype=np.int64)
            yield Fragment(cut=bool(parts), closed=b";".join(groups), links=links, n_a=sum(n_a), n_b=sum(n_b))

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids as the libraries give them for a text between two borders; None if the bytes
        of either are not those of the text."""
        a = np.array(self.first.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        marked = text.startswith(" ")
        b = np.array(self.second.encode(text[1:] if marked else text), dtype=np.int32)
        if not marked and len(b) and self.bytes_b[b[0]] == b" ":
            b = b[1:]  # the mark before a text that begins with other white space
        raw = text.encode()
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != raw or b"".join([self.bytes_b[i] for i in b.tolist()]) != raw:
            return None
        return a, b


EMPTY = np.zeros(0, dtype=np.int32)


@dataclass
class Fragment:
    """What the tokens that end in a byte range say about groups.

    Without a cut inside, ``head`` holds all tokens. With cuts, ``head`` holds the tokens
    up to the first one (none if the range begins at a cut), ``closed`` the groups from
    there to the last as text, ``links`` the id pairs at all cuts, and ``tail`` the tokens
    behind the last one.
    """

    head: tuple[np.ndarray, np.ndarray] = (EMPTY, EMPTY)
    cut: bool = False
    closed: bytes = b""
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    tail: tuple[np.ndarray, np.ndarray] = (EMPTY, EMPTY)
    n_a: int = 0
    n_b: int = 0
    sound: bool = True

    def then(self, other: Fragment) -> Fragment:
        """Composition, associative; the empty fragment changes nothing."""
        counts = self.n_a + other.n_a, self.n_b + other.n_b, self.sound and other.sound
        if not self.cut:
            head = joined(self.head, other.head)
            return Fragment(head, other.cut, other.closed, other.links, other.tail, *counts)
        if not other.cut:
            return Fragment(self.head, True, self.closed, self.links, joined(self.tail, other.head), *counts)
        middle = written(*joined(self.tail, other.head))  # empty between two cuts that meet
        closed = b";".join(x for x in (self.closed, middle, other.closed) if x)
        return Fragment(self.head, True, closed, np.concatenate([self.links, other.links]), other.tail, *counts)

    def groups(self) -> bytes:
        """The text of all groups, for a fragment that covers a whole text."""
        return b";".join(x for x in (written(*self.head), self.closed) if x) if self.sound else b""


def joined(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])


def written(a: np.ndarray, b: np.ndarray) -> bytes:
    """One group, if there are tokens."""
    if not len(a) and not len(b):
        return b""
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}".encode()


class Writer:
    """Writes many groups at once: each token's digits with the mark that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.marked = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]

    def tokens(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """Tokens in the order of writing. ``last_a`` and ``last_b``: positions of the tokens
        that end each group."""
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        ends_a, ends_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before = np.concatenate([[0], last_b + 1])  # tokens of the second kind up to each group
        codes[np.arange(len(a)) + before[group_a]] = a + self.n_a * ends_a
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = b + self.n_b * ends_b + 2 * self.n_a
        return [self.marked[code] for code in codes.tolist()]

    def text(self, *tokens: np.ndarray) -> bytes:
        return "".join(self.tokens(*tokens))[:-1].encode()


def fragment(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, writer: Writer) -> Fragment:
    """The fragment of tokens with these end offsets."""
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    if not len(at_a):
        return Fragment((a, b), n_a=len(a), n_b=len(b))
    first_a, first_b, last_a, last_b = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
    closed = b""
    if len(at_a) > 1:
        closed = writer.text(a[first_a:last_a], b[first_b:last_b], at_a[1:] - first_a, at_b[1:] - first_b)
    links = a[at_a].astype(np.int64) << 32 | b[at_b].astype(np.int64)
    return Fragment((a[:first_a], b[:first_b]), True, closed, links, (a[last_a:], b[last_b:]), len(a), len(b))


def fragment_of(text: str, begin: int, low: int, high: int, tools: Tokenizers) -> Fragment:
    """Tokens of ``text``, which starts at byte ``begin``, that end in (low, high]."""
    ids = tools.encoded(text) if text else (EMPTY, EMPTY)
    if ids is None:
        return Fragment(sound=False)
    parts = []
    for each, sizes in zip(ids, (tools.sizes_a, tools.sizes_b)):
        ends = begin + np.cumsum(sizes[each])
        inside = slice(*np.searchsorted(ends, [low, high], side="right"))
        parts.append((each[inside], ends[inside]))
    return fragment(parts[0][0], parts[1][0], parts[0][1], parts[1][1], tools.writer)


def chunks(text: str, tools: Tokenizers, size: int) -> Iterator[tuple[int, str, int, int, int]]:
    """Number, context, its first byte, and the byte range of each chunk of ``text``.

    Ranges have ``size`` bytes, wherever that cuts. The context reaches from the border
    before the range to the one behind it, so its tokens are those of the whole text.
    """
    raw = text.encode()
    plain = len(raw) == len(text)
    places = np.fromiter(tools.borders(text), dtype=np.int64)
    if not plain:
        widths = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lengths = 1 + (widths > 0x7F).astype(np.int64) + (widths > 0x7FF) + (widths > 0xFFFF)
        places = np.concatenate([[0], np.cumsum(lengths)])[places]
    places = np.unique(np.concatenate([[0], places, [len(raw)]]))
    for number, low in enumerate(range(0, len(raw), size)):
        high = min(low + size, len(raw))
        begin = int(places[np.searchsorted(places, low, side="right") - 1])
        end = int(places[np.searchsorted(places, high, side="left")])
        yield number, raw[begin:end].decode(), begin, low, high


FRAGMENT = (
    "head_a array<int>, head_b array<int>, cut boolean, closed binary, links array<bigint>, tail_a array<int>, tail_b array<int>, "
    "n_a bigint, n_b bigint, sound boolean"
)
FIELDS = [x.split()[0] for x in FRAGMENT.split(", ")]


def fragment_columns(fragments: list[Fragment]) -> list[pa.Array]:
    """The columns of ``FRAGMENT``; closed groups are compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)

    def lists(values: Iterable[np.ndarray], kind: type) -> pa.Array:
        values = list(values)
        flat = np.concatenate(values).astype(kind) if values else np.zeros(0, dtype=kind)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)], dtype=np.int32)), pa.array(flat))

    heads = [lists((x.head[k] for x in fragments), np.int32) for k in (0, 1)]
    tails = [lists((x.tail[k] for x in fragments), np.int32) for k in (0, 1)]
    closed = pa.array([press.compress(x.closed) if x.closed else b"" for x in fragments], pa.binary())
    counts = [pa.array([getattr(x, name) for x in fragments], pa.int64()) for name in ("n_a", "n_b")]
    cut, sound = (pa.array([getattr(x, name) for x in fragments], pa.bool_()) for name in ("cut", "sound"))
    return [*heads, cut, closed, lists((x.links for x in fragments), np.int64), *tails, *counts, sound]


def fragments_in(rows: pd.DataFrame) -> Iterator[Fragment]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for row in rows.itertuples(index=False):
        head, tail = ((np.asarray(getattr(row, f"{x}_a"), np.int32), np.asarray(getattr(row, f"{x}_b"), np.int32)) for x in ("head", "tail"))
        closed = press.decompress(row.closed) if row.closed else b""
        yield Fragment(head, bool(row.cut), closed, np.asarray(row.links, np.int64), tail, int(row.n_a), int(row.n_b), bool(row.sound))


def composed(fragments: DataFrame) -> DataFrame:
    """One fragment per ``content``, composed over a tree of ``FAN_IN`` neighbours.

    ``part`` numbers the fragments of a content. Each step groups by content and part
    divided by ``FAN_IN``, so tasks of a step share a very long text, and the number of
    steps grows with the logarithm of its length.
    """

    def compose(group: pd.DataFrame) -> pa.Table:
        group = group.sort_values("part")
        whole = Fragment()
        for one in fragments_in(group):
            whole = whole.then(one)
        key = [pa.array([group["content"].iloc[0]], pa.binary()), pa.array([int(group["part"].iloc[0]) // FAN_IN], pa.int64())]
        return pa.Table.from_arrays([*key, *fragment_columns([whole])], ["content", "part", *FIELDS])

    def step(table: pa.Table) -> pa.Table:
        return compose(table.to_pandas())

    while not fragments.where("part > 0").isEmpty():
        above = F.expr(f"part DIV {FAN_IN}").alias("above")
        grouped = fragments.groupBy("content", above)
        fragments = stage(grouped.applyInArrow(step, f"content binary, part bigint, {FRAGMENT}"), "alignment-composed")
    return fragments


@dataclass
class Model:
    """The files of the two tokenizers, which travel with the tasks."""

    first: bytes
    second: bytes

    def tools(self) -> Tokenizers:
        """The libraries, loaded once in a worker process for all its tasks."""
        held = vars(sys.modules.setdefault("_aligned_tokenizers", ModuleType("_aligned_tokenizers")))
        key = f"{hash(self.first)} {hash(self.second)}"
        if held.get("key") != key:
            held["tools"], held["key"] = Tokenizers(self.first, self.second), key
        return held["tools"]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``body`` (a space before the text, or empty) and ``bundle``.

    A bundle are rows of about one length next to each other in a file. The longer they
    are, the fewer rows they may stand apart, so a bundle never exceeds ``BUNDLE_BYTES``
    (or one text).
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    body = F.when(text != "", F.concat(F.lit(" "), text)).otherwise("").alias("body")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        rows = docs.select(docs[id_col].alias("id"), body, *place)
    except AnalysisException:
        rows = stage(docs.select(docs[id_col].alias("id"), body), "alignment-rows").select("id", "body", *place)
    window = F.lit(1)
    for most in (1 << 20, 1 << 14, 1 << 10):
        window = F.when(F.octet_length("body") <= most, F.lit(BUNDLE_BYTES // most)).otherwise(window)
    return rows.select("id", "body", "file", "row", window.alias("window")).select(
        "id", "body", F.hash("file", "window", F.expr("row DIV window")).alias("bundle")
    )


RESULT = "n_a bigint, n_b bigint, groups string, links binary"


def result_columns(wholes: Iterable[Fragment]) -> list[pa.Array]:
    """The columns of ``RESULT``; links are compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    nothing = 0, 0, "", press.compress(b"")
    rows = [(x.n_a, x.n_b, x.groups().decode(), press.compress(x.links.tobytes())) if x.sound and x.n_a else nothing for x in wholes]
    kinds = pa.int64(), pa.int64(), pa.string(), pa.binary()
    return [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def short_texts(rows: DataFrame, model: Model) -> DataFrame:
    """Texts of one chunk, each in the task that reads it."""
    kind = rows.schema["id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.tools()
        for batch in slices(batches, "body", 1 << 20):
            wholes = tools.wholes(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("bundle"), *result_columns(wholes)], ["id", "bundle", *NAMES])

    return rows.mapInArrow(align, f"id {kind}, bundle int, {RESULT}")


def long_texts(rows: DataFrame, model: Model, size: int) -> DataFrame:
    """Texts of several chunks, each distinct one once and each chunk in a task of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.tools()
        for batch in slices(batches, "body", 1):
            for content, text in zip(batch.column("content").to_pylist(), batch.column("body").to_pylist()):
                for number, context, *places in chunks(text, tools, size):
                    arrays = [pa.array([x]) for x in (content, number, context, *places)]
                    yield pa.RecordBatch.from_arrays(arrays, ["content", "part", "context", "begin", "low", "high"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.tools()
        for batch in slices(batches, "context", 1 << 20):
            places = zip(*(batch.column(x).to_pylist() for x in ("context", "begin", "low", "high")))
            found = [fragment_of(*place, tools) for place in places]
            yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("part"), *fragment_columns(found)], ["content", "part", *FIELDS])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "links", 1 << 20):
            wholes = fragments_in(batch.select(FIELDS).to_pandas())
            yield pa.RecordBatch.from_arrays([batch.column("content"), *result_columns(wholes)], ["content", *NAMES])

    keyed = rows.withColumn("content", F.unhex(F.md5("body")))
    contents = keyed.select("content", "body").dropDuplicates(["content"])
    parts = contents.mapInArrow(cut, "content binary, part bigint, context string, begin bigint, low bigint, high bigint")
    fragments = spread(parts, "content", "part").mapInArrow(align, f"content binary, part bigint, {FRAGMENT}")
    whole = composed(stage(fragments, "alignment-fragments")).drop("part").mapInArrow(finish, f"content binary, {RESULT}")
    return keyed.select("id", "bundle", "content").join(whole, "content").select("id", "bundle", *NAMES)


def unpacked_links(blobs: Iterable[bytes]) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(x), dtype=np.int64) for x in blobs]


def links_by_bundle(texts: DataFrame) -> DataFrame:
    """``bundle``, ``pair`` (ids of a link in the upper and lower 32 bits), ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in slices(batches, "links", 1 << 20):
            for bundle, links in zip(batch.column("bundle").to_pylist(), unpacked_links(batch.column("links").to_pylist())):
                kept.setdefault(bundle, []).append(links)
                held += len(links)
            if held > 4_000_000:
                yield from counted(kept)
                kept, held = {}, 0
        yield from counted(kept)

    def counted(kept: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for bundle, links in kept.items():
            pairs, n = np.unique(np.concatenate(links), return_counts=True)
            arrays = [pa.array(np.full(len(pairs), bundle, dtype=np.int32)), pa.array(pairs), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, ["bundle", "pair", "n"])

    return texts.select("bundle", "links").mapInArrow(count, "bundle int, pair bigint, n bigint")


def aligned_tokens(
    docs: DataFrame, first: bytes, second: bytes, id_col: str = "doc_id", text_col: str = "text", groups_as=lambda groups: groups, chunk: int = CHUNK
) -> DataFrame:
    """Groups of tokens of two tokenizers that end at the same bytes, and their links.

    ``first`` is a byte-level file of the tokenizers library, which gets the text with a
    space before it; ``second`` a SentencePiece file, which adds that space itself. Special
    tokens are neither added nor read. Bytes at which tokens of both end cut the text into
    groups. The two tokens that end at a cut are linked.

    A text's tokens in a byte range make a ``Fragment``: an open prefix, closed groups, an
    open suffix. Fragments compose associatively, so the chunks of a long text are aligned
    in tasks of their own, each within the nearest borders that no token crosses, and are
    composed over a tree of groupings. Texts of one chunk are aligned where they are read.

    Links are counted over the whole table. Each bundle of rows sends its distinct pairs
    with numbers, gets the totals of its pairs back, and its texts look them up; so no
    occurrence is shuffled as a row. Totals are joined, not broadcast.

    Columns: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose
    total is the highest of their second id), ``count_sum`` (of the totals of all links),
    ``groups`` (ids as ``a1,a2|b1;a3|b2,b3``; ``groups_as`` is applied to it before it is
    written down).

    Defined results: null and empty texts, and those whose bytes one of the tokenizers
    does not give back, have no tokens: zeros and an empty ``groups``. Null ids, ties and
    repeated rows pass row by row, and each repeated row counts. Other columns are ignored.
    An empty table gives no rows.
    """
    model = Model(first, second)
    rows = numbered(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    long = F.octet_length("body") > chunk
    texts = short_texts(rows.where(~long), model).unionByName(long_texts(rows.where(long), model, chunk))
    shown = F.when(F.col("n_a") > 0, groups_as(F.col("groups"))).otherwise("").alias("groups")
    texts = stage(texts.select("id", "bundle", "n_a", "n_b", shown, "links"), "alignment-texts")

    found = stage(links_by_bundle(texts), "alignment-links")
    totals = found.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = stage(totals.withColumn("second", F.expr("pair & 4294967295L")), "alignment-totals")
    highest = totals.groupBy("second").agg(F.max("total").alias("highest"))
    rated = totals.join(highest, "second").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    known = found.select("bundle", "pair").distinct().join(rated, "pair").select("bundle", "pair", "total", "best")

    def look_up(some: pa.Table, table: pa.Table) -> pa.Table:
        pairs = table.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, total, best = pairs[order], table.column("total").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]
        n_links, n_best, sums = [], [], []
        for links in unpacked_links(some.column("links").to_pylist()):
            at = np.searchsorted(pairs, links)
            n_links.append(len(links))
            n_best.append(int(best[at].sum()) if len(at) else 0)
            sums.append(int(total[at].sum()) if len(at) else 0)
        counts = [pa.array(x, pa.int64()) for x in (n_links, n_links, n_best, sums)]
        kept = [some.column(x) for x in ("id", "n_a", "n_b")]
        return pa.Table.from_arrays([*kept, *counts, some.column("groups")], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return texts.groupBy("bundle").cogroup(known.groupBy("bundle")).applyInArrow(look_up, out)
