"""Operator 6: exact token counts of a unigram vocabulary without making tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character, and a
Viterbi pass carries the best score and its number of pieces, nothing else. Ties are broken as the
tokenizers library's Unigram model does: a later candidate wins only with a greater score, and
candidates for an end come from the earliest start first; a character that no one-character piece
covers may be unknown, at 10 below the least score; a run of unknown characters counts a token for
each of its bytes where the vocabulary has byte pieces, else one.

White space becomes U+2581 and one more is put before the text, as the vocabulary expects. No
piece has U+2581 after another character, so texts are cut there, and each distinct part is counted
once per task; sums of scores are exact, so the parts' best paths make the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, offsets_of, only, slices, texts_of
from .textstats import sums

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the Unigram model
PARTS = re.compile(" +[^ ]*|[^ ]+")
MOST_PARTS = 200_000  #: distinct parts that a task remembers


def pieces_of(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces and scores without control, unknown and byte pieces; whether there are byte pieces) of a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return [(p.id_to_piece(i), p.get_score(i)) for i in plain], any(p.is_byte(i) for i in range(p.vocab_size()))


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_fallback: bool):
        self.bytes_fallback = bytes_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        # a part is a run of U+2581 and what follows; a piece that goes on past that can't be kept apart
        self.divisible = not any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a text that begins with U+2581 and has no spaces."""
        n = len(text)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        unknown_run = [0] * (n + 1)  # bytes of the run of unknown characters that ends here
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        for i in range(n):
            best, at, made = None, 0, 0
            for length, s in sorted(ends[i], reverse=True):  # the earliest start first
                before = score[i + 1 - length]
                if best is None or before + s > best:
                    best, at, made = before + s, 0, count[i + 1 - length] + 1
            if text[i] not in self.single and (best is None or score[i] + self.unknown > best):
                size = len(text[i].encode()) if self.bytes_fallback else 1
                at = unknown_run[i] + size
                more = size if self.bytes_fallback else int(unknown_run[i] == 0)
                best, made = score[i] + self.unknown, count[i] + more
            score[i + 1], count[i + 1], unknown_run[i + 1] = best, made, at
        return count[n]

    def counts(self, parts: list[str]) -> np.ndarray:
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        for p in parts:
            if p not in self.known:
                self.known[p] = self.count(p)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text; an empty one has none."""
        if not self.divisible:
            return np.array([self.count(SPACE + t.replace(" ", SPACE)) if t else 0 for t in texts.to_pylist()], np.int64)
        # a text with two spaces together, or one in front, has parts with more than one U+2581
        odd = pc.match_substring_regex(texts, "^ |  ").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
        coded = pc.dictionary_encode(cut.flatten())
        offsets = cut.offsets.to_numpy().astype(np.int64)
        each = self.counts([SPACE + w for w in coded.dictionary.to_pylist()])
        total = sums(each[coded.indices.to_numpy()], offsets - offsets[0])
        total[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        where = np.flatnonzero(odd)
        found = [PARTS.findall(" " + t) for t in texts.take(pa.array(where)).to_pylist()]
        if len(where):
            own = self.counts([p.replace(" ", SPACE) for f in found for p in f])
            total[where] = sums(own, offsets_of(np.array([len(f) for f in found])))
        return total


def counter(path: str) -> Counter:
    return only(("counter", path), lambda: Counter(*pieces_of(path)))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens for each row of docs(doc_id, text): nulls and empty texts have 0. Other columns are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counter(vocabulary).of_texts(texts_of(some.column("text"))))], names=["doc_id", "n_tokens"])

    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens long")
