"""SentencePiece encoding and decoding with a BPE model, by vectorised merge rounds.

The model merges, in a whole text, the adjacent pair whose joined piece has the best score, the
leftmost of equals, until no pair joins to a piece. No merge crosses a place between two characters
that stand side by side in no piece, such as that before a space (written ``▁``) after a letter: a
text is cut there into *words* (all characters that aren't ASCII count as one kind, and are cut apart
nowhere), and each different word is merged once a worker (as in ``tokens``, words known by hash are
compared byte for byte).

The symbols of all new words of a stretch lie in one flat array. In each round every word finds the
least rank among its pairs (a segmented minimum) and merges all its pairs of that rank at once, from
the left and without overlap; then the array is closed up, and words without a pair leave it.
Merging one pair after another could differ from that only where a merge makes a pair of the same
rank or a better one, which would be next: such a merge ends its word's round. A word of over
``LONG`` symbols would need too many rounds; it is merged by itself from a heap, in the same order.

A character that is no piece is coded by its bytes. ``decode`` puts texts together from a flat table of
the pieces' bytes; control ids give nothing, the first piece loses one leading space, and bytes that
are no UTF-8 give U+FFFD each, all as the library does.

Only models are taken that need no more: no normaliser, a leading space for every text, byte pieces,
extra white space kept. Loading one compares its pieces' own texts with the library and raises if they differ.

Defined cases: a null or empty text is its end id alone (none, if no end id is wanted); it decodes to an
empty text, as do null ids; ids outside the vocabulary are an error; repeated rows are coded alike,
an empty table gives no rows; all columns are kept, and one named like the result is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes, tokens

SPACE = "▁"
LONG = 512
NONE = np.int32(1 << 30)
#: Rows coded at a time.
ROWS = 256


class Rounds(tokens.PieceEncoder):
    def __init__(self, path: str, remembered: int = tokens.REMEMBERED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self._empty(self.size, remembered)
        names = sp.id_to_piece(list(range(self.size)))
        self.end_id = sp.eos_id()
        own = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(self.size)]
        pieces = {p: i for i, p in enumerate(names) if own[i]}
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError(f"{path} has no byte pieces")
        self.byte_id = np.array([byte_ids[b] for b in range(256)], np.int64)
        #: Rank of a merge into a piece: 0 is the best score.
        self.rank = np.unique([-s for s in sp.get_score(list(range(self.size)))], return_inverse=True)[1].astype(np.int32)
        chars = {ord(p): i for p, i in pieces.items() if len(p) == 1}
        self.chars = np.array(sorted(chars), np.uint32)
        self.char_id = np.array([chars[c] for c in sorted(chars)], np.int64)
        symbol = lambda p: pieces.get(p, self.size + ord(p) if len(p) == 1 else None)
        merges = {}
        #: Whether a byte (128: any that isn't ASCII) may follow another within a word.
        self.joined = np.zeros((129, 129), bool)
        self.joined[128, 128] = True
        for p, i in pieces.items():
            kinds = [32 if c == SPACE else min(ord(c), 128) for c in p]
            self.joined[kinds[:-1], kinds[1:]] = True
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = i
        self.keys_of = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in sorted(merges)], np.int64)
        texts = ["" if sp.is_control(i) else sp.decode([i]) if sp.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(names)]
        raw = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else t.encode() for i, t in enumerate(texts)]
        self.piece = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_id] = True
        self.is_control = np.array([sp.is_control(i) for i in range(self.size)])
        self.leads = np.array([o and t.startswith(" ") for o, t in zip(own, texts, strict=True)])
        tried = ["", " ", "   ", " ﬁ  Å\tx\n\x00", *(t for t in texts if t)]
        if [x.tolist() for x in self.encode(pa.array(tried))] != sp.encode(tried, num_threads=1):
            raise ValueError(f"{path} isn't coded by merges alone")

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> textbytes.Words:
        n = len(data)
        kind = np.minimum(data, 128).astype(np.intp)
        begins = np.ones(n, bool)
        begins[1:] = ~self.joined.ravel()[kind[:-1] * 129 + kind[1:]]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        hashes = np.zeros(len(start), np.uint64)
        if n:
            size = end - start
            place = np.arange(n) - np.repeat(start, size)
            hashes = textbytes.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * textbytes.multipliers(int(size.max()))[place], start), 0x51ED)
        return textbytes.Words(start, end, hashes, np.searchsorted(start, offsets))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; rank NONE where they join to no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys_of, key), len(self.keys_of) - 1)
        known = self.keys_of[at] == key
        merged = np.where(known, self.merged[at], 0)
        return np.where(known, self.rank[merged], NONE), merged

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, self.char_id[at], self.size + codes.astype(np.int64)), np.array([len(w) for w in words], np.int64)

    def _rounds(self, sym: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, symbols, number of symbols of each) of words that no pair is left in."""
        sym, word = sym.copy(), np.repeat(np.arange(len(sizes)), sizes)
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                gone = np.repeat(done, count)
                yield word[first[done]], sym[gone], count[done]
                sym, word, rank, into = sym[~gone], word[~gone], rank[~gone], into[~gone]
                least, count = least[~done], count[~done]
                if not len(sym):
                    return
            hit = np.flatnonzero(rank == np.repeat(least, count))
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]  # the second of two that overlap waits
            # A merge whose new pairs are as good as this rank, or better, ends the round of its word.
            made, here, least_at = into[hit], word[hit], rank[hit]
            after = np.append(hit[:-1] + 2 == hit[1:], False)
            next_at = np.minimum(hit + 2, len(sym) - 1)
            right = np.where((hit + 2 < len(sym)) & (word[next_at] == here), self._pairs(made, sym[next_at])[0], NONE)
            before = np.maximum(hit - 1, 0)
            left_symbol = sym[before]
            left_symbol[1:] = np.where(after[:-1], made[:-1], left_symbol[1:])
            left = np.where((hit > 0) & (word[before] == here), self._pairs(left_symbol, made)[0], NONE)
            ends = np.flatnonzero(np.minimum(left, right) <= least_at)
            if len(ends):
                which, at = np.unique(here[ends], return_index=True)
                place = np.minimum(np.searchsorted(which, here), len(which) - 1)
                keep = (which[place] != here) | (np.arange(len(hit)) <= ends[at][place])
                hit, made = hit[keep], made[keep]
            sym[hit] = made
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            changed = hit - np.arange(len(hit))  # where the merged symbols are once the array is closed up
            sym, word, rank, into = sym[stays], word[stays], rank[stays], into[stays]
            anew = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            follow = np.minimum(anew + 1, len(sym) - 1)
            rank[anew], into[anew] = self._pairs(sym[anew], sym[follow])
            rank[anew[(anew == len(sym) - 1) | (word[anew] != word[follow])]] = NONE

    def _from_heap(self, sym: np.ndarray) -> np.ndarray:
        """One long word, merge after merge."""
        out = sym.tolist()
        n = len(out)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, into = self._pairs(sym[:-1], sym[1:])
        heap = [(r, i, out[i], out[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), into.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                pair = out[i], out[j]
                if pair not in known:
                    r, p = self._pairs(np.array(pair[:1]), np.array(pair[1:]))
                    known[pair] = int(r[0]), int(p[0])
                if known[pair][0] != NONE:
                    heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, a, b, p = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j < 0 or out[j] != b:
                continue
            out[i], out[j], after[i] = p, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([x for x in out if x >= 0], np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        sym, sizes = self._symbols(pieces)
        short = sizes <= LONG
        word = np.arange(len(pieces))
        found = [(word[short][w], s, n) for w, s, n in self._rounds(sym[np.repeat(short, sizes)], sizes[short])]
        start = np.cumsum(sizes) - sizes
        for i in word[~short].tolist():
            s = self._from_heap(sym[start[i] : start[i] + sizes[i]])
            found.append((np.array([i]), s, np.array([len(s)])))
        order: list[int] = []
        ids, lengths = [], []
        for w, s, n in found:
            s, n = self._bytes(s, n)
            order += w.tolist()
            ids.append(s.astype(self.dtype))
            lengths.append(n)
        return order, ids, lengths

    def _bytes(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, count
        raw = [chr(c).encode() for c in (sym[odd] - self.size).tolist()]
        more = np.ones(len(sym), np.int64)
        more[odd] = [len(r) for r in raw]
        out = np.repeat(sym, more)
        at = (np.cumsum(more) - more)[odd]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        size = more[odd]
        out[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(flat))] = self.byte_id[flat]
        return out, np.add.reduceat(more, np.cumsum(count) - count)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        yield from super().encode(text)

    def _surfaces(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, where each row's begin and the last's end)."""
        size, start = self.piece_size[ids], self.piece_start[ids].copy()
        ends = np.cumsum(counts)
        spoken = np.flatnonzero(~self.is_control[ids])
        first = np.searchsorted(spoken, ends - counts)
        there = first < np.searchsorted(spoken, ends)
        lead = spoken[first[there]]
        lead = lead[self.leads[ids[lead]]]
        start[lead] += 1
        size[lead] -= 1
        after = np.concatenate(([0], np.cumsum(size)))
        return self.piece[np.repeat(start - after[:-1], size) + np.arange(after[-1])], after[np.concatenate(([0], ends))]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows whose ids follow each other, ``counts`` of them each."""
        flat, at = self._surfaces(ids, counts)
        raw = flat.tobytes()
        out = []
        stop = np.cumsum(counts)
        # Bytes on both sides of a control id don't make one character.
        split = np.flatnonzero(self.is_byte[ids[:-1]] & self.is_control[ids[1:]]) + 1
        row = np.searchsorted(stop, split, "right")
        split = set(row[split < stop[row] - 1].tolist()) if len(split) else set()
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            try:
                out.append(raw[a:b].decode() if k not in split else self._loose(ids[stop[k] - counts[k] : stop[k]]))
            except UnicodeDecodeError:
                out.append(self._loose(ids[stop[k] - counts[k] : stop[k]]))
        return out

    def _loose(self, ids: np.ndarray) -> str:
        """A row with bytes that are no UTF-8: each of those is U+FFFD."""
        parts, lo = [], 0
        cuts = np.append(np.flatnonzero(np.diff(self.is_byte[ids])) + 1, len(ids))
        for hi in cuts.tolist():
            run = ids[lo:hi]
            if not self.is_byte[run[0]]:
                parts.append((not self.is_control[ids[:lo]].all(), run))
            else:
                raw, text = self.piece[self.piece_start[run]].tobytes(), ""
                while raw:
                    width = next((k for k in range(1, 5) if _valid(raw[:k])), 0)
                    text, raw = text + (raw[:width].decode() if width else "�"), raw[max(width, 1) :]
                parts.append((True, text))
            lo = hi
        out = ""
        for inner, part in parts:
            if not isinstance(part, str):
                size, start = self.piece_size[part], self.piece_start[part]
                words = [self.piece[s : s + n].tobytes().decode() for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                spoken = np.flatnonzero(~self.is_control[part])
                if not inner and len(spoken) and self.leads[part[spoken[0]]]:
                    words[spoken[0]] = words[spoken[0]][1:]
                part = "".join(words)
            out += part
        return out


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, Rounds] = {}


def model(path: str) -> Rounds:
    """One a worker and model file."""
    if path not in _models:
        _models[path] = Rounds(path)
    return _models[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what a worker holds follows from those."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [column], kept + [name])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, end: bool = True) -> DataFrame:
    """``docs`` with the ids of each whole text, an array of ints, and an end id after them. decoded: also
    the text of those ids, in a column of this name (by the same worker, which knows the model once)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        tail = [coder.end_id] if end else []
        for batch in _slices(batches):
            found = [np.append(x, tail).astype(np.int32) for x in coder.encode(batch.column(batch.schema.get_field_index(text)))]
            counts = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate(found)
            made = _put(batch, ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat)))
            yield _put(made, decoded, pa.array(coder.decode(flat, counts), pa.string())) if decoded else made

    schema = _with(docs.schema, ids, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(encoded, _with(schema, decoded, T.StringType()) if decoded else schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in _slices(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not (flat.min() >= 0 and flat.max() < coder.size):
                raise ValueError(f"ids outside the vocabulary of {path}")
            yield _put(batch, text, pa.array(coder.decode(flat, counts), pa.string()))

    return rows.mapInArrow(decoded, _with(rows.schema, text, T.StringType()))
