"""Token counts of every prefix of a text, for merge-based SentencePiece models."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

#: How SentencePiece writes a space, also put before the text.
SPACE = "▁"
#: Texts are counted in segments that no merge can cross: a model is looked through for
#: a piece that spans the end of a segment, and the first form without one is taken.
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
SEGMENTS = [
    re.compile(f"{SPACE}*{LETTER}+|{SPACE}+(?:(?!{SPACE}|{LETTER}).)*|(?:(?!{SPACE}|{LETTER}).)+", re.DOTALL),
    re.compile(f"{SPACE}+[^{SPACE}]*"),
    re.compile(".+", re.DOTALL),
]


def segment_form(pieces: Iterable[str]) -> re.Pattern:
    inner = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}
    return next(form for form in SEGMENTS if all(form.findall(SPACE + x)[-1].endswith(x) for x in inner))


#: What one task keeps of segments and of pairs of tokens it has met.
SEGMENTS_KEPT, PAIRS_KEPT = 200_000, 1 << 19


class PrefixCounter:
    """Counts by dynamic programming over prefixes.

    The encoding of a prefix is the encoding of a shorter prefix and one more token:
    the token that stays apart from the token before it. So the last token of each
    prefix follows from the last tokens of shorter ones, and its count is one more
    (or, for a character without a piece, its bytes more). An automaton of all pieces
    names the pieces that end at each character.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
        self.rank = {
            library.id_to_piece(i): -library.get_score(i)
            for i in range(library.get_piece_size())
            if not any(is_kind(i) for is_kind in special)
        }
        self.cut = segment_form(self.rank)
        self.halves = lru_cache(PAIRS_KEPT)(self._halves)
        self.ends = ahocorasick.Automaton()
        for number, piece in enumerate(self.rank, 1):
            if self.halves(piece) is not None:
                self.ends.add_word(piece, (number, len(piece), piece))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, np.ndarray] = {}

    def _halves(self, token: str) -> tuple[float, str, str] | None:
        """When ``token`` arises and from which two; None if merging never gives it.

        Merges go lowest rank first and leftmost among equals.
        """
        if len(token) == 1:
            return -np.inf, "", ""
        symbols = list(token)
        while len(symbols) > 2:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:])]
            if (low := min(ranks)) == np.inf:
                return None
            at = ranks.index(low)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return self.rank[token], symbols[0], symbols[1]

    def apart(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, stay two.

        Goes back in time from the finished tokens: the later made of the two symbols
        at the border is taken apart, and the symbols then at the border must not have
        merged with each other before (on a tie the pair further left merges first).
        """
        until = np.inf
        while True:
            if (rank := self.rank.get(left + right)) is not None and rank < until:
                return False
            made_left, _, inner_left = self.halves(left)
            made_right, inner_right, _ = self.halves(right)
            if made_left > made_right:
                until, left = made_left, inner_left
            elif made_right > -np.inf:
                until, right = made_right + 0.5, inner_right
            else:
                return True

    def counted(self, text: str) -> list[int]:
        """Tokens of each nonempty prefix of a segment."""
        return self.walked(text)[1][1:]

    def tokens(self, text: str) -> list[str]:
        """The encoding of a segment itself."""
        last, end, out = self.walked(text)[0], len(text), []
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def walked(self, text: str) -> tuple[list[str], list[int]]:
        """Last token and number of tokens of each prefix."""
        names, tokens, total = [0] * (len(text) + 1), [""] * (len(text) + 1), [0] * (len(text) + 1)
        pairs, done = self.pairs, 0
        for end, (number, length, piece) in self.ends.iter(text):
            end += 1
            if end == done:
                continue
            while done < end - 1:  # a character that ends no piece
                self.lone(text, done, names, tokens, total)
                done += 1
            start = end - length
            if start:
                pair = names[start] << 32 | number
                stays = pairs.get(pair) if names[start] >= 0 else True
                if stays is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    stays = pairs[pair] = self.apart(tokens[start], piece)
                if not stays:
                    continue
            names[end], tokens[end], total[end] = number, piece, total[start] + 1
            done = end
        while done < len(text):
            self.lone(text, done, names, tokens, total)
            done += 1
        return tokens, total

    @staticmethod
    def lone(text: str, at: int, names: list[int], tokens: list[str], total: list[int]) -> None:
        """A character without a piece of its own becomes its bytes."""
        names[at + 1], tokens[at + 1], total[at + 1] = -1, text[at], total[at] + len(text[at].encode())

    def segment(self, text: str) -> bytes:
        """Tokens of each nonempty prefix of one segment, as the bytes of integers."""
        counts = array("i", self.counted(text)).tobytes()
        if len(text) <= 64:
            if len(self.kept) >= SEGMENTS_KEPT:
                self.kept.clear()
            self.kept[text] = counts
        return counts

    def prefixes(self, text: str) -> np.ndarray:
        """Element k: tokens of the first k characters."""
        if not text:
            return np.zeros(1, dtype=np.int32)
        kept, segment = self.kept, self.segment
        parts = [kept.get(x) or segment(x) for x in self.cut.findall(SPACE + text.replace(" ", SPACE))]
        counts = np.frombuffer(b"".join(parts), dtype=np.int32).copy()
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // counts.itemsize
        totals = counts[np.cumsum(lengths) - 1]
        counts += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
        counts[0] = 0  # the mark before the text alone: the empty prefix
        return counts


def token_prefixes(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``n_bytes``, ``prefix_tokens``; one row per input row.

    ``prefix_tokens[k]`` is the exact number of tokens of the first k code points, so
    ``token_count``, ``tokens_of_prefix`` and ``characters_within`` answer length,
    truncation and budget questions from it without encoding again. ``model`` is the
    content of a SentencePiece file of merges (BPE); it travels with the task.

    Defined results: null and empty texts have the one prefix of 0 tokens. Null ids,
    repeated rows and ties pass through row by row. Memory follows the longest text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in slices(batches, "body"):
            arrays = [counter.prefixes(text) for text in batch.column("body").to_pylist()]
            offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.ListArray.from_arrays(offsets, values)],
                ["id", "n_bytes", "prefix_tokens"],
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("body").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, prefix_tokens array<int>")


def token_count(prefix_tokens: Column) -> Column:
    return F.element_at(prefix_tokens, -1).cast("long")


def tokens_of_prefix(prefix_tokens: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` code points, or of all if there are fewer."""
    wanted = F.lit(characters) if isinstance(characters, int) else characters
    return F.get(prefix_tokens, F.least(F.greatest(wanted, F.lit(0)), F.size(prefix_tokens) - 1)).cast("long")


def characters_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """The longest prefix, in code points, of at most ``budget`` tokens.

    Counts may fall by a few when a character completes a token, so the last fitting
    prefix is sought and not the first that doesn't fit.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefix_tokens, lambda tokens, at: F.when(tokens <= limit, at))
    return F.array_max(fits).cast("long")
