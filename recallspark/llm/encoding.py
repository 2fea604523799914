"""Exact batch encoding with the tokenizers library, one call per distinct piece of text.

A byte-level or word-level BPE never merges across the places where a run of white space
follows a visible character, so a text may be cut there, each distinct piece encoded once by
the library and the ids put together again: the same ids as from encoding whole texts. The
library is used as it comes: the strings of its added tokens in a text are these tokens.

The byte-level pre-tokenizer's own pattern ends a run of letters at any other character and a run
of visible ones at white space, so its texts are also cut there, which leaves fewer distinct
pieces: words without the marks and line ends that follow them.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import offsets_of, only, ragged

#: Code points with the White_Space property, as a character class.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PIECES = re.compile(f"{SPACE}*[^{SPACE[1:]}+|{SPACE}+")
#: Texts are cut before single spaces; a space after other white space is left to PIECES.
ODD_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
SPACES = ODD_SPACE[:-1] + "+"


class Encoder:
    """ids of whole texts; `spaced`: white space before a word counts (byte-level vocabularies)."""

    def __init__(self, path: str, spaced: bool, most_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.most_pieces = spaced, most_pieces
        form = json.loads(self.tokenizer.to_str())
        split = form["pre_tokenizer"] or {}
        #: whether texts may be cut where the byte-level pattern cuts
        self.fine = spaced and form["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.added = [x["content"] for x in form["added_tokens"]]
        size = self.tokenizer.get_vocab_size()
        # each character of a byte-level token stands for one byte
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i).removesuffix("</w>")) for i in range(size)], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths = [], []
        self.all = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.used = np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Keep the pieces used most, half of the store at most."""
        flat, lengths = self._store()
        used = np.append(self.used, np.zeros(len(lengths) - len(self.used), np.int64))
        keep = np.sort(np.argsort(-used, kind="stable")[: self.most_pieces // 2])
        keep = keep[used[keep] > 1]
        pieces = list(self.index)
        self.all = (ragged(flat, offsets_of(lengths)[keep], lengths[keep]), lengths[keep])
        self.index = {pieces[i]: n for n, i in enumerate(keep.tolist())}
        self.used = np.zeros(len(keep), np.int64)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece in the store, after encoding those not met yet."""
        codes = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        where = np.flatnonzero(codes < 0)
        if len(where):
            missed = [pieces[i] for i in where.tolist()]
            new = list(dict.fromkeys(missed))
            # one that ends in white space, or begins with other than one space, can't stand in a row of pieces
            alone, rows, lines = [], [], []
            for p in new:
                if not self.spaced or p[:1] == " " and not p[-1].isspace():
                    rows.append(p)
                elif p and not p[0].isspace() and not p[-1].isspace():
                    lines.append(p)
                else:
                    alone.append(p)
            for some, glue in ((rows, "" if self.spaced else " "), (lines, "\n")):
                for i in range(0, len(some), 2000):
                    self._add_row(some[i : i + 2000], glue)
            self._add_each(alone)
            codes[where] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        return codes

    def _add(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.flat.append(flat)
        self.lengths.append(lengths)

    def _add_each(self, pieces: list[str]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._add(pieces, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))

    def _add_row(self, pieces: list[str], glue: str) -> None:
        """Encode the pieces as one text and part its ids again by the bytes they stand for.

        A line end between visible characters is an id of its own, which is left out.
        """
        text = glue.join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        plain = pieces if self.spaced else self.tokenizer.normalizer.normalize_str(text).split(" ")
        between = int(self.spaced and glue == "\n")
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + between) - between
        if not text.isascii():  # from characters to bytes
            raw = np.frombuffer((glue if between else "").join(plain).encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[ends]
        reach = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(reach, ends)
        whole = len(plain) == len(pieces) and len(reach) and reach[-1] == ends[-1] and np.array_equal(reach[np.minimum(at, len(reach) - 1)], ends)
        if whole and between:
            lines = at[:-1] + 1
            whole = np.array_equal(reach[lines], ends[:-1] + 1)
        if not whole:
            return self._add_each(pieces)
        lengths = np.diff(at + 1, prepend=0)
        if between:
            ids = np.delete(ids, lines)
            lengths[1:] -= 1
        return self._add(pieces, ids, lengths)

    def _store(self) -> tuple[np.ndarray, np.ndarray]:
        if self.flat:
            self.all = (np.concatenate([self.all[0], *self.flat]), np.concatenate([self.all[1], *self.lengths]))
            self.flat, self.lengths = [], []
        return self.all

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets of the texts in them) for a string array without nulls."""
        if len(self.index) > self.most_pieces:
            self._trim()
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = self._odd(texts) if self.spaced else np.zeros(0, np.int64)
        plain = texts if self.spaced else pc.replace_substring_regex(texts, SPACES, " ")
        if len(odd):
            mask = np.zeros(n, bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        if self.spaced:
            pieces, offsets = self._cut(plain)
        else:
            cut = pc.split_pattern(plain, " ")
            offsets = cut.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            pieces = cut.flatten()
        coded = pc.dictionary_encode(pieces)
        codes = self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        if len(odd):
            codes, offsets = self._with_odd(texts, odd, codes, offsets)
        flat, lengths = self._store()
        self.used = np.append(self.used, np.zeros(len(lengths) - len(self.used), np.int64)) + np.bincount(codes, minlength=len(lengths))
        starts = offsets_of(lengths)
        took = lengths[codes]
        ids = ragged(flat, starts[codes], took)
        return ids, offsets_of(took)[offsets]

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """The texts that are left to PIECES: a space after other white space, or an added token."""
        b, offsets = bytes_of(texts)
        if len(b) < 2:
            return np.zeros(0, np.int64)
        space = b[1:] == 32
        at = np.flatnonzero(space & ((b[:-1] == 32) | (b[:-1] - np.uint8(9) < 5)))
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, at + 1, side="right") - 1] = True
        # white space beyond ASCII doesn't begin with the byte that Latin letters with accents begin with
        high = space & (b[:-1] > 127)
        high[1:] &= b[:-2] != 0xC3
        perhaps = np.unique(np.searchsorted(offsets, np.flatnonzero(high) + 1, side="right") - 1)
        if len(perhaps):
            odd[perhaps] |= pc.match_substring_regex(texts.take(pa.array(perhaps)), ODD_SPACE).to_numpy(zero_copy_only=False)
        for token in self.added:
            if (b == token.encode()[0]).any():
                odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return np.flatnonzero(odd)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces one after another, offsets of the texts in them) for texts that are not odd."""
        b, offsets = bytes_of(texts)
        begins = b == 32
        if self.fine and len(b) > 2:
            line, visible = b == 10, b - np.uint8(33) < 94
            letter = (b | 32) - np.uint8(97) < 26
            other = (b < 128) & ~letter
            # two-byte Latin letters but the signs of multiplication and division
            letter[1:] |= (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
            begins[1:] |= (letter[:-1] & other[1:]) | (visible[:-1] & line[1:])
            # after one line end that follows a visible character
            begins[2:] |= visible[2:] & line[1:-1] & begins[1:-1]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(b))), pa.py_buffer(b))
        return pieces, np.searchsorted(starts, offsets)

    def _with_odd(self, texts, odd, codes, offsets):
        """The codes with those of the odd texts, cut by PIECES, in their places."""
        found = [PIECES.findall(t) for t in texts.take(pa.array(odd)).to_pylist()]
        extra = self._codes([p for f in found for p in f])
        starts, lengths = offsets[:-1].copy(), np.diff(offsets)
        lengths[odd] = [len(f) for f in found]
        starts[odd] = len(codes) + offsets_of(lengths[odd])[:-1]
        return ragged(np.concatenate([codes, extra]), starts, lengths), offsets_of(lengths)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the texts in them) of a large_string array without nulls."""
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.zeros(0, np.uint8) if values is None else np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    return held, offsets - offsets[0]


def encoder(path: str, spaced: bool, most_pieces: int = 300_000) -> Encoder:
    """One per Python worker; its store of pieces is bounded."""
    return only(("encoder", path, spaced, most_pieces), lambda: Encoder(path, spaced, most_pieces))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
