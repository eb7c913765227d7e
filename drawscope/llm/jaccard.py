"""N-gram Jaccard similarity join by chosen paths.

Texts are sets of hashed word 5-grams. Equal word sequences are one class from the start
(copies are never compared). A class has a signature: its least shingle under each of a number
of seeded orders, so two sets agree in one coordinate with the probability of their Jaccard
similarity. A *run* splits all sets by a sampled coordinate of its own: sets that share the
token chosen there share a bucket. A bucket of over ``limit`` sets is split again by further
sampled coordinates, and so on down the path. Small buckets are compared by brute force, with
exact set similarity. A bucket that is still large at the last level (a group of near copies,
which no token parts) is compared exactly too, in blocks of bounded size (``limit`` signatures, then
``block`` sets and ``block_weight`` shingles), one task for each pair of blocks.

Before any text is read again, the pairs of a bucket are filtered by their signatures: pairs
that agree in fewer coordinates than all but very few similar pairs do are dropped.

Runs are repeated until the target recall: a pair at the similarity threshold survives a run
with a probability that follows from the branching, and ``runs_for`` takes as many runs as
lower the chance to miss it in all of them below half of ``1 - recall``; the filter's chance is
below the other half. (More similar pairs are missed less.)

Two sets can meet in several leaves. They are compared only in the first leaf, in a fixed
order of paths, that both are in, so links are counted once and pairs are never written:
a block returns each set's number of links and the edges of a spanning forest.

Rows are numbered once, in a table written to the shared folder; a class goes by the least row of its word sequence,
and everything is joined by row or class, never by id.

Defined cases: null and wordless texts are in no class (class_id is their own id, no links,
one copy) and are all kept; texts of fewer than five words are one shingle of all their words;
every row takes part with its own text, also where ids are null or repeated (two classes may then have the
same least id; ``class_no`` tells them apart); rows with equal words are copies of each other; an empty table gives
an empty result; further columns are dropped by ``similar`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..scratch import materialise, release
from . import textbytes
from .joins import few

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
LIMIT = 1024
BLOCK = 1024
BLOCK_WEIGHT = 1 << 20
TILE = 256
BRANCHES = 2
LEVELS = 3


def runs_for(recall: float, threshold: float = THRESHOLD, branches: int = BRANCHES, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most 1 - recall."""
    deeper = 1.0
    for _ in range(levels - 1):
        deeper = 1 - (1 - threshold * deeper) ** branches
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * deeper))


def least_agreeing(coordinates: int, recall: float, threshold: float = THRESHOLD) -> int:
    """The most agreeing coordinates that a pair at the threshold falls short of with a chance
    of at most 1 - recall."""
    below, k = 0.0, 0
    while True:
        below += math.comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if below > 1 - recall:
            return k
        k += 1


def coordinates(runs: int, branches: int = BRANCHES, levels: int = LEVELS) -> int:
    """Every node of every run's tree samples a coordinate of its own, so runs fail independently."""
    return runs * sum(branches**k for k in range(levels))


def _least_shingles(sh: np.ndarray, at: np.ndarray, c: int) -> np.ndarray:
    """Each text's least shingle (32 bits) under the c-th order."""
    seed, factor = (np.uint64(x) for x in textbytes.mix(np.array([2 * c, 2 * c + 1], np.uint64), 77))
    return np.minimum.reduceat((((sh ^ seed) * (factor | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), at)


def shingles(w: textbytes.Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, each text's first): a short text is one shingle of all its words."""
    n = np.diff(w.first)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    g = textbytes.grams(w.hash, k)
    at = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    out = np.zeros(first[-1], np.uint64)
    whole = np.repeat(n >= k, count)
    out[whole] = g[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        a = w.first[i]
        out[first[i]] = textbytes.grams(w.hash[a : a + n[i]], int(n[i]))[0]
    return out, first


def _keys(w: textbytes.Words, first: np.ndarray) -> list[bytes]:
    """Two hashes of the word sequence of each text that starts at a word of ``first``."""
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
    most = int(place.max()) + 1
    key = np.stack([np.add.reduceat(textbytes.mix(w.hash, seed) * textbytes.multipliers(most, seed)[place], first) for seed in (1, 2)], axis=1)
    return [row.tobytes() for row in key]


def _signatures(spread: int):
    kind = pa.list_(pa.int32())

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textbytes.chunks(batch.column(2)):
                w = textbytes.words(data, offsets)
                sh, first = shingles(w)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                at = first[full]
                least = np.stack([_least_shingles(sh, at, c) for c in range(spread)], axis=1)
                flat = pa.array(least.view(np.int32).ravel())
                row, of = (batch.column(i).slice(lo, hi - lo).take(pa.array(full)) for i in (0, 1))
                signature = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * spread), flat).cast(kind)
                yield pa.RecordBatch.from_arrays([row, of, pa.array(_keys(w, w.first[full]), pa.binary()), pa.array(np.diff(first)[full]), signature], ["row", "id", "key", "size", "signature"])

    return signed


def _leaves(classes: DataFrame, runs: int, limit: int, branches: int, levels: int) -> DataFrame:
    """(col, path, m, rep, size): leaves of two sets or more. ``col`` is the node of the run's
    tree (0: root, then level by level) and the run; it orders the paths."""
    shares = classes.select("rep", "size", "signature")
    below = sum(branches**k for k in range(1, levels))
    level = shares.select("rep", "size", F.posexplode(F.slice("signature", 1, runs)).alias("col", "value")).select("rep", "size", F.col("col").cast("long").alias("col"), F.xxhash64("col", "value").alias("path"))
    out, made = None, []
    for depth in range(levels):
        # Written first, so that the join is one of plain tables, whose hot paths Spark can split.
        counted = materialise(level.groupBy("col", "path").agg(F.count("*").alias("m")).where("m > 1"), "path-sizes")
        made.append(counted)
        sized = materialise(level.join(counted, ["col", "path"]), f"paths-{depth}")
        made.append(sized)
        last = depth == levels - 1
        leaf = sized if last else sized.where(F.col("m") <= limit)
        out = leaf if out is None else out.unionByName(leaf)
        large = sized.where(F.col("m") > limit)
        if last or not large.limit(1).count():
            break
        run, node = F.col("col") % 65536, F.shiftright("col", 16)
        extra = F.slice("signature", (runs + run * below + node * branches + 1).cast("int"), branches)
        split = large.join(shares.select("rep", "signature"), "rep").select("rep", "size", "col", "path", F.posexplode(extra).alias("branch", "value"))
        level = split.select("rep", "size", ((node * branches + F.col("branch") + 1) * 65536 + run).cast("long").alias("col"), F.xxhash64("path", "branch", "value").alias("path"))
    return out, made


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _paths_matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, path of each set in each of them; 0: none) of lists of (col, path) structs."""
    lists = pa.concat_arrays(column.chunks)
    flat = lists.flatten()
    at, path = flat.field("col").to_numpy(), flat.field("path").to_numpy()
    names = np.unique(at)
    out = np.zeros((len(lists), len(names)), np.int64)
    out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), np.searchsorted(names, at)] = path
    return names, out


def _met_before(earlier: np.ndarray, left: np.ndarray, right: np.ndarray, alone: bool) -> np.ndarray:
    """Which pairs meet in an earlier leaf, or (within a block) are no pair of two sets."""
    out = left[:, None] >= right[None, :] if alone else np.zeros((len(left), len(right)), bool)
    for c in range(earlier.shape[1]):
        x, y = earlier[left, c][:, None], earlier[right, c][None, :]
        out |= (x == y) & (x != 0)
    return out


def _earlier(table: pa.Table) -> np.ndarray:
    """Paths of each set in the columns before the table's."""
    names, matrix = _paths_matrix(table.column("paths"))
    return matrix[:, names < table.column("col")[0].as_py()]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    alone = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    return left, left if alone else np.flatnonzero(side == 1), alone


def _promising(table: pa.Table, least: int) -> pa.Table:
    """Sets of a block (or pair of blocks) that agree with another in ``least`` coordinates or more."""
    left, right, alone = _sides(table)
    earlier = _earlier(table)
    signatures = pa.concat_arrays(table.column("signature").chunks).flatten().to_numpy().reshape(table.num_rows, -1)
    good = np.zeros(table.num_rows, bool)
    for lo in range(0, len(left), TILE):
        part = left[lo : lo + TILE]
        agreeing = np.zeros((len(part), len(right)), np.int16)
        for c in range(signatures.shape[1]):
            agreeing += signatures[part, c][:, None] == signatures[right, c][None, :]
        hit = (agreeing >= least) & ~_met_before(earlier, part, right, alone)
        good[part[hit.any(axis=1)]] = True
        good[right[hit.any(axis=0)]] = True
    rows = np.flatnonzero(good)
    return table.select(["col", "path", "rep", "size"]).take(pa.array(rows))


def _compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links and spanning edges within a block, or between the two blocks of a pair."""
    left, right, alone = _sides(table)
    reps = table.column("rep").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
    sizes = np.array([len(s) for s in sets])
    links = np.zeros(len(sets), np.int64)
    vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
    # Shingles of one set only can't be shared; the others make a dense 0/1 matrix, in strips.
    common = np.flatnonzero(np.bincount(code, minlength=len(vocabulary)) > 1)
    dense = np.full(len(vocabulary), -1, np.int64)
    dense[common] = np.arange(len(common))
    shared = np.zeros((len(left), len(right)), np.float32)
    row_of = np.repeat(np.arange(len(sets)), sizes)
    place = dense[code]
    order = np.argsort(place, kind="stable")
    order = order[place[order] >= 0]
    strip = max(1, min(len(common), max(256, (4 << 20) // len(sets))))
    bounds = np.searchsorted(place[order], np.arange(0, len(common) + strip, strip))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        m = np.zeros((len(sets), strip), np.float32)
        m[row_of[order[a:b]], place[order[a:b]] - k * strip] = 1
        shared += m[left] @ m[right].T
    both = sizes[left][:, None] + sizes[right][None, :] - shared
    hit = shared >= threshold * both - 1e-9
    hit &= ~_met_before(_earlier(table), left, right, alone)
    np.add.at(links, left, hit.sum(axis=1))
    np.add.at(links, right, hit.sum(axis=0))
    i, j = np.nonzero(hit)
    near = _forest(zip(left[i].tolist(), right[j].tolist(), strict=True), len(sets))
    linked = np.flatnonzero(links)
    return pa.table(
        {
            "rep": pa.array(np.concatenate([reps[linked], reps[[a for a, _ in near]]]).astype(np.int64)),
            "links": pa.array(np.concatenate([links[linked], np.zeros(len(near), np.int64)])),
            "to": pa.array([None] * len(linked) + [int(reps[b]) for _, b in near], pa.int64()),
        }
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in textbytes.chunks(batch.column(1)):
            sh, first = shingles(textbytes.words(data, offsets))
            sets = [np.unique(sh[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["rep", "set"])


def _dealt(leaves: DataFrame, limit: int, block_weight: int | None = None) -> DataFrame:
    """Members of leaves, once for each pair of blocks they take part in. A leaf of more than
    ``limit`` sets, or ``block_weight`` shingles, has several blocks, dealt by hash."""
    n = F.ceil(F.col("m") / limit)
    if block_weight:
        n = F.greatest(n, F.ceil(F.col("weight") / block_weight))
    member = leaves.withColumn("nb", n.cast("int")).withColumn("b", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).otherwise(F.lit(0)))
    pairs = member.select("col", "path", "rep", "size", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    return pairs.select("col", "path", "rep", "size", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))


def classified(table: DataFrame, text: Column, key: Column, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, block_weight: int = BLOCK_WEIGHT, branches: int = BRANCHES, levels: int = LEVELS) -> DataFrame:
    """(row, id, class_no, best, n_links, n_copies) of the rows of a written, numbered table whose
    texts hold words; ``best`` is the class's first row: (none, id, row) of the least id, null last."""
    runs = runs_for(1 - (1 - recall) / 2, threshold, branches, levels)
    spread = coordinates(runs, branches, levels)
    rows = table.select("row", key.cast("long").alias("id"), text.cast("string").alias("text"))
    signed = materialise(rows.where("text is not null").mapInArrow(_signatures(spread), "row bigint, id bigint, key binary, size bigint, signature array<int>"), "signatures")
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    # A class goes by its least row.
    groups = materialise(signed.groupBy("key").agg(F.min("row").alias("rep"), F.min(best).alias("best"), F.count("*").alias("n_copies")), "classes")
    first = materialise(signed.join(groups.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "size", "signature"), "firsts")
    leaves, made = _leaves(first, runs, limit, branches, levels)
    of = materialise(leaves.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("col", "path"))).alias("paths")), "leaves-of")
    # All pairs of a leaf have met before if its sets share one first leaf and this is another.
    home = leaves.join(of.select("rep", F.col("paths")[0].alias("home")), "rep").groupBy("col", "path").agg(F.min("home").alias("low"), F.max("home").alias("high"))
    useful = materialise(home.where((F.col("low") != F.col("high")) | (F.col("low") == F.struct("col", "path"))).select("col", "path"), "useful")
    signed_of = of.join(first.select("rep", "signature"), "rep")
    least = least_agreeing(spread, 1 - (1 - recall) / 2, threshold)
    filtered = _dealt(leaves.join(useful, ["col", "path"]), limit).join(signed_of, "rep").groupBy("col", "path", "bi", "bj").applyInArrow(lambda t: _promising(t, least), "col bigint, path bigint, rep bigint, size bigint")
    leaves = materialise(filtered.distinct(), "leaves")
    wanted = materialise(leaves.select("rep").distinct(), "wanted")
    # Only texts of sets with a promising partner are read again, one of each class.
    texts = rows.select(F.col("row").alias("rep"), "text").join(few(wanted), "rep", "left_semi")
    sets = texts.mapInArrow(_sets, "rep bigint, set binary")
    full = materialise(of.join(sets, "rep").select("rep", "paths", "set"), "sets")
    weights = materialise(leaves.groupBy("col", "path").agg(F.count("*").alias("m"), F.sum("size").alias("weight")), "leaf-weights")
    task = _dealt(leaves.join(weights, ["col", "path"]), block, block_weight).join(full, "rep")

    def compared(part: pa.Table) -> pa.Table:
        return _compared(part, threshold)

    found = materialise(task.groupBy("col", "path", "bi", "bj").applyInArrow(compared, "rep bigint, links bigint, to bigint"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    # By rounds at every size: the links grow with the documents.
    grouped = components(found.where("to is not null").select("rep", "to"), "rep", "to", one_task=0).select(F.col("node").alias("rep"), "component")
    of_class = groups.join(counts, "rep", "left").join(grouped, "rep", "left").select("key", F.coalesce("component", "rep").alias("class_no"), "best", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    of_class = materialise(of_class, "classes-linked")
    bests = of_class.groupBy("class_no").agg(F.min("best").alias("best"))
    out = signed.select("row", "id", "key").join(of_class.drop("best").join(bests, "class_no"), "key").drop("key")
    release(first, full, of, leaves, useful, weights, wanted, found, groups, *made)
    return out


def _numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")), "numbered")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(id, class_id, n_links, n_copies, class_no) for every row.

    class_id: least id of the texts that a chain of similar texts reaches. n_links: number of
    other word sequences similar to the row's. n_copies: rows with the row's word sequence.
    class_no: a number of the class's own (null for rows in no class). options: as of ``classified``.
    """
    table = _numbered(docs, [key, text])
    body, of = F.col("doc").getField(text).cast("string"), F.col("doc").getField(key).cast("long")
    known = classified(table, body, of, **options).select("id", F.col("best.id").alias("class_id"), "n_links", "n_copies", "class_no")
    wordless = ~F.coalesce(F.rlike(body, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))
    others = table.where(wordless).select(of.alias("id"), of.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("class_no"))
    return known.unionByName(others)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents, one of each class: its first row in the order of ids, null last."""
    table = _numbered(docs, docs.columns)
    classes = classified(table, F.col("doc").getField(text), F.col("doc").getField(key), **options)
    gone = materialise(classes.where(F.col("row") != F.col("best.row")).select("row"), "gone")
    return table.join(few(gone), "row", "left_anti").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
