"""Whole texts to token ids with a public tokenizer file, a word at a time.

The tokenizer normalises and splits text so that no token reaches across white space: its
normaliser works character by character (a white-space character composes with nothing), and
its splitter drops white space. So a text's ids are the ids of its white-space separated
pieces in a row, and each different piece has to be encoded only once a worker. A test holds
this against encoding whole texts. Only the six ASCII white-space characters part pieces.
Pieces are looked up by a 64-bit hash, and every one of them is compared byte for byte with the
piece whose ids it is given; one that only shares the hash is encoded by itself.

Where the tokenizer's file has the normaliser and the splitter of ``PARTED``, a piece of plain letters
and then signs is looked up as two, its letters with A-Z lower-cased: the splitter parts them there,
and the normaliser takes these characters one by one. So "word", "Word," and "WORD!" are learned once.

Special-token strings are recognised as the library does by default; they hold no white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from . import textbytes

END_ID = 2

#: Pieces, and bytes of them, that a worker remembers; further ones are encoded for each batch and forgotten.
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 1 << 24

IS_PIECE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Letters, then signs of ASCII other than the apostrophe: one word, or one and the signs.
LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]+)[!-&(-/:-@\[-`{-~]*\Z").match

#: (normaliser, splitter) of tokenizer files whose letters and signs part.
PARTED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
SIGNS = rb"!\"#$%&()*+,-./:;<=>?@[\]^_`{|}~"
#: Pieces that normaliser and splitter of ``PARTED`` leave as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: No piece of letters and then signs holds what this finds.
SIGN_THEN_LETTER = re.compile(f"[{re.escape(SIGNS.decode())}][A-Za-z]").search
#: Kinds of bytes: white space, ASCII letters, first and further bytes of U+00C0 to U+017F, signs, others.
WHITE, LETTER, LEAD, FURTHER, SIGN, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[~IS_PIECE] = WHITE
KIND[np.r_[65:91, 97:123]] = LETTER
KIND[0xC3:0xC6] = LEAD
KIND[0x80:0xC0] = FURTHER
KIND[list(SIGNS)] = SIGN


def plain_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, cuts): in pieces of letters and then signs, A-Z lower-cased, and where the signs begin.

    Letters are those of ASCII and U+00C0 to U+017F but the capital I with a dot, whose lower case ends
    in a mark. All other pieces stay as they are.
    """
    n = len(data)
    kind = KIND[data]
    first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    lead, further, sign = kind == LEAD, kind == FURTHER, kind == SIGN
    odd = kind == OTHER
    odd[1:] |= further[1:] & ~lead[:-1]
    odd[:-1] |= lead[:-1] & ~further[1:]
    odd[first] |= further[first]  # no character reaches from one text into the next
    odd[last] |= lead[last]
    signed = np.zeros(n, bool)  # after a sign
    signed[1:] = sign[:-1]
    signed[first] = False
    odd |= ((kind == LETTER) | lead) & signed
    for a, b in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):
        at = np.flatnonzero(data[1:] == b) + 1
        odd[at[data[at - 1] == a]] = True
    begins = kind != WHITE
    begins[1:] &= kind[:-1] == WHITE
    begins[first] = True
    piece = np.cumsum(begins)
    plain = np.ones(len(begins) + 1, bool)
    plain[piece[odd]] = False
    cuts = np.flatnonzero(sign[1:] & ((kind[:-1] == LETTER) | further[:-1])) + 1
    large = np.flatnonzero((data >= 65) & (data <= 90))
    folded = data.copy()
    folded[large[plain[piece[large]]]] |= 32
    return folded, cuts[plain[piece[cuts]]]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending hashes, where each is first, which of them each hash is)."""
    of, seen = pd.factorize(hashes)
    order = np.argsort(seen)
    place = np.empty(len(seen), np.int64)
    place[order] = np.arange(len(seen))
    new = np.concatenate(([True], of[1:] > np.maximum.accumulate(of)[:-1]))  # found in the order they first come
    return seen[order], np.flatnonzero(new)[order], place[of]


class PieceEncoder:
    parted = False

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values(), default=0) + 1
        self._empty(top, remembered)
        # Where the tokenizer marks word ends and parts letters from signs, many simple pieces
        # can be encoded in one call and parted again at the marks.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(top, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marked = bool(suffix) and [len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in ("a", "a,")] == [1, 2]
        made = json.loads(self.tokenizer.to_str())
        self.parted = (made["normalizer"], made["pre_tokenizer"]) == PARTED and all(SIGN_THEN_LETTER(t["content"]) for t in made["added_tokens"])
        if self.parted:  # the same model, without the steps that change nothing of plain pieces
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _empty(self, top: int, remembered: int) -> None:
        """No piece known yet, of a vocabulary of ``top`` ids."""
        self.dtype = np.dtype("<u4" if top > 1 << 16 else "<u2")
        self.remembered = remembered
        self.keys = np.zeros(0, np.uint64)  # hashes of the pieces known, ascending
        self.row = np.zeros(0, np.int32)  # of each of them
        self.start = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, self.dtype)
        self.text = np.zeros(1 << 14, np.uint8)  # bytes of the pieces known
        self.text_start = np.zeros(1 << 12, np.int32)
        self.text_size = np.zeros(1 << 12, np.int32)
        self.rows = self.used = self.text_used = 0

    def _parts(self, data: np.ndarray, offsets: np.ndarray, *cuts: np.ndarray) -> textbytes.Words:
        """The pieces of the texts."""
        return textbytes.words(data, offsets, IS_PIECE, None, *cuts)

    def _encoded(self, pieces: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """(order, ids, lengths): the pieces' positions as encoded, and their ids and lengths in stretches."""
        order: list[int] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        rest: list[int] = []
        plain = [i for i, p in enumerate(pieces) if PLAIN(p)] if self.parted and self.marked else []
        simple: list[int] = []
        expected: list[int] = []
        others = range(len(pieces)) if not plain else np.delete(np.arange(len(pieces)), plain).tolist()
        for i in others:
            p = pieces[i]
            m = LETTERS_THEN_SIGNS(p) if self.marked else None
            if m:
                simple.append(i)
                expected.append(2 if m.end(1) < len(p) else 1)
            else:
                rest.append(i)
        step = 512
        for some, words in ((plain, [1] * len(plain)), (simple, expected)):
            parts = [some[i : i + step] for i in range(0, len(some), step)]
            by = self.model if some is plain and parts else self.tokenizer
            batch = by.encode_batch_fast([" ".join([pieces[i] for i in part]) for part in parts], add_special_tokens=False)
            for k, (part, e) in enumerate(zip(parts, batch, strict=True)):
                x = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[x]) + 1
                want = np.cumsum(words[k * step : (k + 1) * step])
                # No piece gives fewer words than expected, so an equal total means an equal number each.
                if len(cuts) == want[-1] and cuts[-1] == len(x):
                    order += part
                    ids.append(x)
                    lengths.append(np.diff(cuts[want - 1], prepend=0))
                else:
                    rest += part
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            x = np.array(e.ids, self.dtype)
            order.append(i)
            ids.append(x)
            lengths.append(np.array([len(x)]))
        return order, ids, lengths

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """The rows given to the pieces."""
        order, ids, by = self._encoded(pieces)
        lengths = np.concatenate(by)
        n, total = self.rows + len(order), self.used + int(lengths.sum())
        while len(self.start) < n:
            self.start, self.length, self.text_start, self.text_size = (np.concatenate([x, np.zeros(len(x) // 2, x.dtype)]) for x in (self.start, self.length, self.text_start, self.text_size))
        while len(self.flat) < total:
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2, self.dtype)])
        self.length[self.rows : n] = lengths
        self.start[self.rows : n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : total] = np.concatenate(ids)
        given = np.empty(len(order), np.int64)
        given[order] = np.arange(self.rows, n)
        self.rows, self.used = n, total
        return given

    def _remember(self, place: np.ndarray, keys: np.ndarray, rows: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        total = int(size.sum())
        while len(self.text) < self.text_used + total:
            self.text = np.concatenate([self.text, np.zeros(len(self.text) // 2, np.uint8)])
        first = np.cumsum(size) - size
        self.text[self.text_used : self.text_used + total] = data[np.arange(total) + np.repeat(start - first, size)]
        self.text_start[rows], self.text_size[rows] = self.text_used + first, size
        self.keys, self.row = np.insert(self.keys, place, keys), np.insert(self.row, place, rows)
        self.text_used += total

    def _stretch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end)."""
        cuts = []
        if self.parted and len(data):
            data, *cuts = plain_parts(data, offsets)
        pieces = self._parts(data, offsets, *cuts)
        if not len(pieces.hash):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        start, size = pieces.start, pieces.end - pieces.start
        seen, at, inverse = distinct(pieces.hash)
        place = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == seen[inside]
        found = np.zeros(len(seen), np.int64)
        found[known] = self.row[place[known]]
        # A piece may share the hash of the first one here, or of a remembered one, and differ.
        first = at[inverse]
        odd = textbytes.differ(data, start, size, data, start[first], size[first])
        where, old = at[known], found[known].astype(np.int64)
        strange = np.zeros(len(seen), bool)
        strange[known] = textbytes.differ(data, start[where], size[where], self.text, self.text_start[old], self.text_size[old])
        odd |= strange[inverse]
        new = np.flatnonzero(~known)

        def texts(at: np.ndarray) -> list[bytes]:
            raw = data.tobytes()
            return [raw[a:b] for a, b in zip(start[at].tolist(), pieces.end[at].tolist(), strict=True)]

        kept_rows, kept_used = self.rows, self.used
        more = at[new]
        forget = len(self.keys) + len(new) > self.remembered or self.text_used + int(size[more].sum()) > REMEMBERED_BYTES
        if len(new):
            found[new] = self._learn([t.decode("utf-8", "replace") for t in texts(more)])
            if not forget:
                self._remember(place[new], seen[new], found[new], data, start[more], size[more])
                kept_rows, kept_used = self.rows, self.used
        rows = found[inverse]
        alone = np.flatnonzero(odd)
        if len(alone):
            wanted = texts(alone)
            different = list(dict.fromkeys(wanted))
            given = dict(zip(different, self._learn([t.decode("utf-8", "replace") for t in different]).tolist(), strict=True))
            rows[alone] = [given[t] for t in wanted]
        lengths = self.length[rows].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        take = np.repeat(self.start[rows] - ends[:-1], lengths) + np.arange(ends[-1])
        ids = self.flat[take]
        self.rows, self.used = kept_rows, kept_used
        return ids, ends[pieces.first]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in the narrowest of two- or four-byte integers; null is empty."""
        for _, _, data, offsets in textbytes.chunks(column):
            ids, where = self._stretch(data, offsets)
            for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                yield ids[a:b]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One a worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, end_id: int = END_ID) -> np.ndarray:
    return np.append(ids, np.array(end_id, ids.dtype))
