"""Benchmark decontamination by winnowing.

Of each text's word k-grams, the one of least hash in every window of ``w`` successive
k-grams is kept as a fingerprint. Two texts that share a span of at least ``k + w - 1`` words
share the same window of k-grams in it, hence the same least one: with ``span = k + w - 1``
no shared span of ``span`` words can be missed. Where a document's fingerprint meets an
item's, the hit is extended word by word to both sides, and counts where at least ``span``
words agree (the bytes of the words are compared, not only their hashes). Items of fewer
than ``span`` words are one window, found by the hash of the whole item.

The index over the items is sent to the executors in blocks of about ``BLOCK_CHARS``
characters of items, one after the other: driver and executors hold one block at a time. One
block, which any usual benchmark fits in, is one pass over the
documents without a shuffle; more blocks are one pass each over the documents, which are numbered
and written first, and their hits are joined by that number. The result is the same.

Defined cases: null and wordless texts have no words and no hits; null and wordless items
have no windows; items that share an id are one item, and so are those with a null id, which
``items`` names by a null at its end; every document is marked on
its own, also where ids are null or repeated, whatever the number of blocks; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from . import textbytes

SPAN = 10
K = 5
BLOCK_CHARS = 32 << 20
#: Spans compared word by word at a time.
COMPARED = 1 << 15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Spans:
    """The different spans of one length of all items: sorted hashes (equal ones differ in bytes), a place where
    each stands, and the number of the set of items that hold it."""

    hash: np.ndarray
    word: np.ndarray
    of: np.ndarray


@dataclass
class Index:
    """Winnowed items: their fingerprints, and the spans of ``span`` words, or of a whole shorter item, by length."""

    names: list[str | None]  # sorted, null last
    span: int
    k: int
    prints: np.ndarray  # sorted, different
    filter: np.ndarray
    spans: dict[int, Spans]
    set_start: np.ndarray  # of each set of items, and the end of the last
    set_names: np.ndarray  # places in ``names``, ascending within a set
    text: np.ndarray  # bytes of all words, one after another
    start: np.ndarray  # of each word there, and the end of the last


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """First words of the k-grams kept, for texts that start at words ``first``."""
    n = len(hashes)
    g = textbytes.grams(hashes, k)
    m = len(g)
    if m < w:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))  # of each word's text
    g[np.arange(m) + k > end[:m]] = _TOP  # k-grams that cross into the next text
    least = g[: m - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, g[j : m - w + 1 + j], out=least)
    whole = np.arange(m - w + 1) + k + w - 1 <= end[: m - w + 1]
    kept = np.zeros(m, bool)
    for j in range(w):
        kept[j : m - w + 1 + j] |= whole & (g[j : m - w + 1 + j] == least)
    assert n >= m
    return np.flatnonzero(kept)


def _grams_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``textbytes.grams`` at some places."""
    out = hashes[at].copy()
    for j in range(1, k):
        out *= textbytes.BASE
        out += hashes[at + j]
    return textbytes.mix(out, int(k))


def _differ(data: np.ndarray, start: np.ndarray, at: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_at: np.ndarray, length: int) -> np.ndarray:
    """Which spans of ``length`` words are not, word for word, the others'. ``start`` has the end of the last word too,
    or is a pair of starts and ends."""
    out = np.zeros(len(at), bool)
    for lo in range(0, len(at), COMPARED):
        x = (at[lo : lo + COMPARED, None] + np.arange(length)).ravel()
        y = (other_at[lo : lo + COMPARED, None] + np.arange(length)).ravel()
        begin, end = start if isinstance(start, tuple) else (start[:-1], start[1:])
        wrong = textbytes.differ(data, begin[x], end[x] - begin[x], other, other_start[y], other_start[y + 1] - other_start[y])
        out[lo : lo + COMPARED] = wrong.reshape(-1, length).any(axis=1)
    return out


def _classes(hashes: np.ndarray, at: np.ndarray, length: int, text: np.ndarray, start: np.ndarray) -> tuple[Spans, np.ndarray]:
    """(the different spans, which of them each given one is)."""
    order = np.lexsort((at, hashes))
    hashes, at = hashes[order], at[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    leader = np.repeat(first, np.diff(np.append(first, len(hashes))))
    left = np.flatnonzero(leader != np.arange(len(hashes)))
    while len(left):  # spans of one hash that differ from its first become spans of their own
        odd = left[_differ(text, start, at[left], text, start, at[leader[left]], length)]
        if len(odd):
            new = np.flatnonzero(np.append(True, hashes[odd][1:] != hashes[odd][:-1]))
            leader[odd] = np.repeat(odd[new], np.diff(np.append(new, len(odd))))
        left = odd[leader[odd] != odd]
    heads, of = np.unique(leader, return_inverse=True)
    given = np.empty(len(order), np.int64)
    given[order] = of
    return Spans(hashes[heads], at[heads], np.zeros(len(heads), np.int64)), given


def _sets(owner: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each span's set of items, starts of sets, names in them): spans of the same items share a set."""
    pairs = np.unique(of * np.int64(1 << 32) + owner)
    of, owner = pairs >> 32, pairs & np.int64((1 << 32) - 1)
    size = np.bincount(of, minlength=n)
    at = np.cumsum(size) - size
    sums = [np.add.reduceat(textbytes.mix(owner.astype(np.uint64), seed), at) if n else np.zeros(0, np.uint64) for seed in (3, 5)]
    key = textbytes.mix(sums[0] ^ textbytes.mix(sums[1] + size.astype(np.uint64)))
    _, head, like = np.unique(key, return_index=True, return_inverse=True)
    head = head[like]
    # Sets that agree in the sums are compared name by name.
    same = size == size[head]
    long = np.flatnonzero(same)
    inner = np.arange(int(size[long].sum())) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
    unlike = owner[np.repeat(at[long], size[long]) + inner] != owner[np.repeat(at[head[long]], size[long]) + inner]
    same[np.repeat(long, size[long])[unlike]] = False
    head = np.where(same, head, np.arange(n))
    kept, number = np.unique(head, return_inverse=True)
    take = np.arange(int(size[kept].sum())) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept]) + np.repeat(at[kept], size[kept])
    return number, np.concatenate(([0], np.cumsum(size[kept]))), owner[take].astype(np.int32)


def build_index(items: list[tuple[str | None, str]], span: int = SPAN, k: int = K) -> Index:
    names = sorted({i for i, _ in items}, key=lambda x: (x is None, x or ""))
    name_of = {x: n for n, x in enumerate(names)}
    owners = np.array([name_of[i] for i, _ in items], np.int64)
    prints, raw, sizes = [], [], []
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # length: hashes, first words, owners
    base = 0
    for lo, _, data, offsets in textbytes.chunks(pa.array([t for _, t in items], pa.string())):
        words = textbytes.words(data, offsets)
        prints.append(textbytes.grams(words.hash, k)[winnow(words.hash, words.first, k, span - k + 1)])
        n = np.diff(words.first)
        for length in np.unique(np.minimum(n[n > 0], span)).tolist():
            rows = np.flatnonzero(n >= span if length == span else n == length)
            count = n[rows] - length + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[rows], count)
            found.setdefault(length, []).append((_grams_at(words.hash, at, length), at + base, owners[lo + np.repeat(rows, count)]))
        size = words.end - words.start
        raw.append(textbytes.LOWER[data[np.repeat(words.start - np.cumsum(size) + size, size) + np.arange(size.sum())]])
        sizes.append(size)
        base += len(words.hash)
    text = np.concatenate([np.zeros(0, np.uint8), *raw])
    start = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
    out = Index(names, span, k, np.unique(np.concatenate([np.zeros(0, np.uint64), *prints])), np.zeros(1, bool), {}, np.zeros(1, np.int64), np.zeros(0, np.int32), text, start)
    of, owner, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for length, parts in found.items():
        hashes, at, who = (np.concatenate(x) for x in zip(*parts, strict=True))
        out.spans[length], which = _classes(hashes, at, length, text, start)
        of.append(which + n)
        owner.append(who)
        n += len(out.spans[length].hash)
    number, out.set_start, out.set_names = _sets(np.concatenate(owner), np.concatenate(of), n)
    n = 0
    for table in out.spans.values():
        table.of = number[n : n + len(table.hash)]
        n += len(table.hash)
    out.filter = np.zeros(1 << max(16, len(out.prints).bit_length() + 4), bool)
    out.filter[(out.prints & np.uint64(len(out.filter) - 1)).astype(np.int64)] = True
    return out


def _near_prints(index: Index, words: textbytes.Words) -> np.ndarray:
    """First words of the spans of a document that hold a fingerprint of its own which some item has too."""
    none = np.zeros(0, np.int64)
    kept = winnow(words.hash, words.first, index.k, index.span - index.k + 1)
    if not len(kept) or not len(index.prints):
        return none
    prints = _grams_at(words.hash, kept, index.k)
    maybe = index.filter[(prints & np.uint64(len(index.filter) - 1)).astype(np.int64)]
    kept, prints = kept[maybe], prints[maybe]
    at = np.minimum(np.searchsorted(index.prints, prints), len(index.prints) - 1)
    kept = kept[index.prints[at] == prints]
    if not len(kept):
        return none
    text = np.searchsorted(words.first, kept, "right") - 1
    lo = np.maximum(kept - (index.span - index.k), words.first[text])
    hi = np.minimum(kept, words.first[text + 1] - index.span)
    n = np.maximum(hi - lo + 1, 0)
    return np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))


def mark(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str | None]]]:
    """Per text: number of words, hit stretches of words (merged), ids of the items that occur (sorted, null last)."""
    words = textbytes.words(data, offsets)
    n, n_texts = len(words.hash), len(offsets) - 1
    turns = np.zeros(n + 1, np.int64)  # spans that begin at a word, less those that end before it
    pairs = [np.zeros(0, np.int64)]  # text and set of items, in one number
    lowered = None
    for length, table in index.spans.items():
        if length == index.span:
            at = _near_prints(index, words)
        else:
            at = np.arange(max(0, n - length + 1))
            at = at[at + length <= np.repeat(words.first[1:], np.diff(words.first))[: len(at)]]
        if not len(at):
            continue
        hashes = _grams_at(words.hash, at, length)
        lo, hi = np.searchsorted(table.hash, hashes, "left"), np.searchsorted(table.hash, hashes, "right")
        while True:  # once, unless different spans of items share a hash
            met = np.flatnonzero(lo < hi)
            if not len(met):
                break
            if lowered is None:
                lowered = textbytes.LOWER[data]
            sure = met[~_differ(lowered, (words.start, words.end), at[met], index.text, index.start, table.word[lo[met]], length)]
            np.add.at(turns, at[sure], 1)
            np.add.at(turns, at[sure] + length, -1)
            text = np.searchsorted(words.first, at[sure], "right") - 1
            pairs.append(np.unique(text * np.int64(1 << 32) + table.of[lo[sure]]))
            lo = lo + 1
    stretches: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    inside = np.cumsum(turns[:-1]) > 0
    if inside.any():
        edge = np.zeros(n + 1, bool)  # a text's first word
        edge[words.first] = True
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        end = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        text = np.searchsorted(words.first, begin, "right") - 1
        for t, a, b in zip(text.tolist(), (begin - words.first[text]).tolist(), (end - words.first[text]).tolist(), strict=True):
            stretches[t].append((a, b))
    found: list[list[str | None]] = [[] for _ in range(n_texts)]
    met = np.unique(np.concatenate(pairs))
    if len(met):
        text, which = met >> 32, met & np.int64((1 << 32) - 1)
        cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(text)], strict=True):
            sets = [index.set_names[index.set_start[s] : index.set_start[s + 1]] for s in which[lo:hi].tolist()]
            held = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
            found[int(text[lo])] = [index.names[i] for i in held.tolist()]
    return np.diff(words.first), stretches, found


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = "struct<n_words:bigint,spans:array<struct<lo:bigint,hi:bigint>>,items:array<string>>"


def _named(found: set[str | None]) -> list[str | None]:
    return sorted(found, key=lambda x: (x is None, x or ""))


def _marker(sent):
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    @F.arrow_udf(_RESULT)
    def marked(column: pa.Array) -> pa.Array:
        counts, spans, items = [], [], []
        for _, _, data, offsets in textbytes.chunks(column):
            n, s, f = mark(sent.value, data, offsets)
            counts += n.tolist()
            spans += [[{"lo": a, "hi": b} for a, b in x] for x in s]
            items += f
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return marked


def _joiner():
    @F.arrow_udf(_RESULT)
    def joined(counts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
        """What several blocks found in each text, as one block would have found it."""
        merged = [[{"lo": a, "hi": b} for a, b in _merged([(x["lo"], x["hi"]) for part in row for x in part])] for row in spans.to_pylist()]
        names = [_named({x for part in row for x in part}) for row in items.to_pylist()]
        return pa.StructArray.from_arrays([counts, pa.array(merged, spans.type.value_type), pa.array(names, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return joined


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """(number of blocks, what collects one of them)."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-chars // block_chars))
    return n, lambda b: sorted(((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents with a struct column ``__hits``: n_words, spans (merged stretches of hit
    words, [lo, hi)) and items (sorted ids as strings). ``key`` plays no part: rows have numbers of their own."""
    context = docs.sparkSession.sparkContext
    n, block = _blocks(benchmark, item, item_text, block_chars)
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "__hits")).alias("doc")
    send = lambda b: context.broadcast(build_index(block(b), span, k))
    body = F.col("doc").getField(text).cast("string")
    if n == 1:
        return docs.select(kept).select("doc", _marker(send(0))(body).alias("__hits")).select("doc.*", "__hits")
    # Ids may be null or repeated. A number of the row's own stays the same once it is written.
    numbered = materialise(docs.select(kept, F.monotonically_increasing_id().alias("row")), "numbered")
    counted, passes = None, []
    for b in range(n):
        sent = send(b)
        found = materialise(numbered.select("row", _marker(sent)(body).alias("h")).where(F.lit(b == 0) | (F.size("h.items") > 0)), f"hits-{b}")
        sent.destroy()  # the pass is written: nothing reads this block again
        counted = counted or found.select("row", F.col("h.n_words").alias("n"))
        passes.append(found.where(F.size("h.items") > 0))
    hits = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.collect_list("h.spans").alias("s"), F.collect_list("h.items").alias("i"))
    out = numbered.join(counted, "row").join(hits, "row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(hits.dtypes)[c]))
    return out.select("doc", _joiner()(F.col("n"), none("s"), none("i")).alias("__hits")).select("doc.*", "__hits")


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
