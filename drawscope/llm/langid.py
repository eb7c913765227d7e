"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``order``: per context, how often each next
byte followed in the training texts. A byte that followed a context of n bytes in all, q of
them different, c times, costs ``log2((n + q) / c)`` bits there; any other byte costs the
escape ``log2((n + q) / q)`` and is then coded by the context one byte shorter, down to a
uniform order of 8 bits. A context the language never showed is passed at no cost. The
statistics are frozen after training, so a text's code length is an exact sum (in double
precision), and the language with the shortest code wins.

Trees are kept sparse: for each language and order, the sorted codes (nine bits a symbol) of
the grams and contexts that training showed, with their bits. Because nothing adapts, the
cost of a byte depends on it and the ``order`` symbols before it alone; a worker remembers
the costs of the grams it has met, in a table of at most ``REMEMBERED_BYTES``.

There is no limit on languages. The training sample is bounded: ``per_language`` texts of a language, and
``max_bytes`` of text in all, an equal share for each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language first in string order; with no training rows at all every text is ``und``; every
row, repeated or not, with an id or without, is scored on its own; null and extra columns of the input are kept
untouched by ``with_language`` (its three output columns replace columns of the same names).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes

UND = "und"
#: Stands before a text's first byte.
EDGE = 256
SYMBOL_BITS = 9
MOST = 64 // SYMBOL_BITS - 1
REMEMBERED_BYTES = 1 << 23
#: Bytes, and languages, that are worked on at once.
STRETCH = 1 << 18
AT_ONCE = 8
OUTPUT = ("lang_pred", "score", "lang_bits")


@dataclass(frozen=True)
class Order:
    """One order of a language's tree: sorted codes with their bits."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


@dataclass(frozen=True)
class ContextTrees:
    languages: tuple[str, ...]
    trees: tuple[tuple[Order, ...], ...]  # by language, then order
    order: int
    key: str


def _codes(data: np.ndarray, offsets: np.ndarray, order: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """For each byte from ``lo`` to ``hi``, it and the ``order`` symbols before it; the byte is lowest."""
    hi = len(data) if hi is None else hi
    symbols = np.full(order + hi - lo, EDGE, np.uint64)
    known = max(0, lo - order)
    symbols[order - (lo - known) :] = data[known:hi]
    begins = offsets[:-1][(offsets[:-1] > lo - order) & (offsets[:-1] < hi)] - lo
    out = symbols[order:].copy()
    for j in range(1, order + 1):
        before = symbols[order - j : order - j + hi - lo].copy()
        for k in range(j):  # a byte that has but k before it in its text
            at = begins + k
            before[at[(at >= 0) & (at < hi - lo)]] = EDGE
        out |= before << np.uint64(SYMBOL_BITS * j)
    return out


def _tree(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[Order, ...]:
    whole = _codes(data, offsets, order)
    out = []
    for k in range(order + 1):
        grams, counts = np.unique(whole & np.uint64((1 << SYMBOL_BITS * (k + 1)) - 1), return_counts=True)
        contexts, of, kinds = np.unique(grams >> np.uint64(SYMBOL_BITS), return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=counts, minlength=len(contexts)) + kinds
        out.append(Order(grams, np.log2(total[of] / counts) if len(grams) else np.zeros(0), contexts, np.log2(total / kinds)))
    return tuple(out)


def train(texts: dict[str, list[str]], order: int = 3) -> ContextTrees:
    """Context trees of whole texts by language (driver side; the caller bounds the sample)."""
    languages = tuple(sorted(texts))
    trees = []
    for language in languages:
        raw = [t.encode() for t in texts[language] if t]
        offsets = np.cumsum([0, *map(len, raw)])
        trees.append(_tree(np.frombuffer(b"".join(raw), np.uint8), offsets, order))
    return ContextTrees(languages, tuple(trees), order, uuid.uuid4().hex)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is there, and where)."""
    at = np.searchsorted(sorted_, wanted)
    there = at < len(sorted_)
    there[there] = sorted_[at[there]] == wanted[there]
    return there, at


def costs(model: ContextTrees, codes: np.ndarray) -> np.ndarray:
    """[gram, language]: bits of the last symbol of each gram of ``order`` + 1 symbols."""
    out = np.zeros((len(codes), len(model.languages)))
    for lang, tree in enumerate(model.trees):
        left = np.arange(len(codes))  # grams whose symbol no order has coded yet
        for k in range(model.order, -1, -1):
            gram = codes[left] & np.uint64((1 << SYMBOL_BITS * (k + 1)) - 1)
            there, at = _find(tree[k].grams, gram)
            out[left[there], lang] += tree[k].bits[at[there]]
            left, gram = left[~there], gram[~there]
            there, at = _find(tree[k].contexts, gram >> np.uint64(SYMBOL_BITS))
            out[left[there], lang] += tree[k].escapes[at[there]]
        out[left, lang] += 8.0
    return out


class Costs:
    """Costs of the grams met so far, found by a hash table with one place a gram."""

    def __init__(self, model: ContextTrees, remembered_bytes: int = REMEMBERED_BYTES):
        self.model = model
        self.most = max(1, remembered_bytes // (8 * max(1, len(model.languages))))
        self.bits = min(21, max(4, (4 * self.most).bit_length()))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, np.uint64)  # no gram's code
        self.row = np.zeros(1 << self.bits, np.int64)
        self.table = np.zeros((0, len(self.model.languages)))
        self.used = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``table`` of the grams; good until the next call."""
        slot = (codes * textbytes.BASE) >> np.uint64(64 - self.bits)
        out = self.row[slot]
        missed = np.flatnonzero(self.keys[slot] != codes)
        if not len(missed):
            return out
        new, inverse = np.unique(codes[missed], return_inverse=True)
        if self.used and self.used + len(new) > self.most:
            self._clear()
            return self.rows(codes)
        while len(self.table) < self.used + len(new):
            self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table) // 2), self.table.shape[1]))])
        place = (new * textbytes.BASE) >> np.uint64(64 - self.bits)
        # A gram takes its place if that is free and no other of the new ones takes it; others are forgotten again.
        _, first = np.unique(place, return_index=True)
        kept = np.zeros(len(new), bool)
        kept[first] = self.keys[place[first]] == np.uint64(0xFFFFFFFFFFFFFFFF)
        row = np.empty(len(new), np.int64)
        order = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept)])
        row[order] = self.used + np.arange(len(new))
        self.table[row] = costs(self.model, new)
        self.keys[place[kept]], self.row[place[kept]] = new[kept], row[kept]
        self.used += int(kept.sum())
        out[missed] = row[inverse]
        return out


_ready: dict[str, Costs] = {}


def _costs(model: ContextTrees) -> Costs:
    """Workers keep one model."""
    if model.key not in _ready:
        _ready.clear()
        _ready[model.key] = Costs(model)
    return _ready[model.key]


def code_lengths(model: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact bits of each text under each language."""
    met = _costs(model)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets))
    begin = offsets[full]
    for lo in range(0, len(data), STRETCH):
        hi = min(len(data), lo + STRETCH)
        rows = met.rows(_codes(data, offsets, model.order, lo, hi))
        a, b = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
        at = np.maximum(begin[a:b] - lo, 0)
        for lang in range(0, len(model.languages), AT_ONCE):
            part = slice(lang, lang + AT_ONCE)
            out[full[a:b], part] += np.add.reduceat(met.table[:, part][rows], at, axis=0)
    return out


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def predict(model: ContextTrees, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, its bits a byte) of each text.

    The score is the language's share of ``2 ** -(bits of eight average bytes)`` over all languages, so it
    tells how far apart the languages are, and not how long the text is.
    """
    names: list[str] = []
    scores, per_byte = np.zeros(len(column)), np.zeros(len(column))
    for lo, hi, data, offsets in textbytes.chunks(column):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=sums[1:])
        letters = sums[offsets[1:]] > sums[offsets[:-1]]
        for i in np.flatnonzero(~letters):
            letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        if not model.languages:
            names += [UND] * (hi - lo)
            continue
        length = code_lengths(model, data, offsets)
        best = length.argmin(axis=1)
        mean = length / np.maximum(np.diff(offsets), 1)[:, None]
        least = mean.min(axis=1)
        share = 1 / np.exp2(np.clip(8 * (least[:, None] - mean), -1000, 0)).sum(axis=1)
        scores[lo:hi], per_byte[lo:hi] = np.where(letters, share, 0.0), least
        names += [model.languages[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
    return names, scores, per_byte


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 150, order: int = 3, max_bytes: int = 64 << 20) -> ContextTrees:
    """Train on a bounded sample of whole texts: of each language, the ``per_language`` texts of least
    hash (of key and text), as far as they fit in the language's share of ``max_bytes``; equal rows count
    once. A language whose texts are all longer than its share is trained on the shortest drawn.

    The driver sees hashes and lengths of about twice as many rows, and the chosen texts. order: at most
    ``MOST`` (a gram of order + 1 symbols is one 64-bit code).
    """
    if not 0 <= order <= MOST:
        raise ValueError(f"order {order} is not within 0 to {MOST}")
    t = F.col(text)
    rows = labelled.select(t.alias("t"), F.col(label).cast("string").alias("l"), F.xxhash64(F.col(key).cast("string"), t).alias("h"), F.octet_length(t).alias("n")).where("t is not null and l is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train({}, order)
    spark = labelled.sparkSession
    # About twice the wanted rows lie below a threshold on the hash.
    share = spark.createDataFrame([(name, min(1.0, (2.0 * per_language + 20) / n)) for name, n in sizes.items()], "l string, share double")
    unit = (F.col("h").cast("double") / F.lit(float(2**64))) + F.lit(0.5)
    drawn = rows.join(F.broadcast(share), "l").where(unit <= F.col("share")).groupBy("l", "h").agg(F.min("n").alias("n")).collect()
    most = max_bytes // len(sizes)
    chosen: dict[str, list] = {}
    for name in sizes:
        mine = sorted((r.h, r.n) for r in drawn if r.l == name)
        taken, used = [], 0
        for h, n in mine:
            if len(taken) < per_language and used + n <= most:
                taken.append(h)
                used += n
        chosen[name] = taken or [h for h, _ in sorted(mine, key=lambda x: (x[1], x[0]))[:1]]
    pairs = spark.createDataFrame([(name, h) for name, hs in chosen.items() for h in hs], "l string, h long")
    found = rows.join(F.broadcast(pairs), ["l", "h"], "left_semi").groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    by: dict[str, list] = {name: [] for name in sizes}
    for r in sorted(found, key=lambda r: r.h):
        by[r.l].append(r.t)
    return train(by, order)


def language_column(df: DataFrame, model: ContextTrees, text: str = "text") -> Column:
    """A struct column (lang_pred, score, lang_bits) from ``text`` alone."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,lang_bits:double>")
    def language(column: pa.Array) -> pa.Array:
        names, scores, per_byte = predict(sent.value, column)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(per_byte)], list(OUTPUT))

    # Else a filter on what is found runs it a second time, in further workers of the same task.
    return language.asNondeterministic()(F.col(f"`{text}`").cast("string"))


def with_language(df: DataFrame, model: ContextTrees, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and lang_bits, the bits a byte of the text under that language
    (over 8: no learned language codes it better than bytes drawn at random)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in OUTPUT]
    both = df.select(F.struct(*kept).alias("row"), language_column(df, model, text).alias("found"))
    return both.select("row.*", "found.*")
