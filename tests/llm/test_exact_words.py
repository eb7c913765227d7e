"""Words that structured hashes confuse, and packing whatever the number of tasks."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_files_and_packing import check_pieces, plain_ids

from drawscope.llm import jaccard, packing, textbytes, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def swapped(k, a="a", b="b"):
    """The two Thue-Morse words of 2**k letters (or words)."""
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_swapped_words_have_their_own_ids():
    texts = [w for k in (10, 11, 12) for w in swapped(k)]
    made = tokens.PieceEncoder(PATH)
    for _ in range(2):
        assert [[*x.tolist(), 2] for x in made.encode(pa.array(texts))] == plain_ids(texts)


@pytest.mark.parametrize("remembered", [1_000_000, 4])
def test_pieces_that_share_a_hash_are_told_apart(monkeypatch, remembered):
    real = textbytes.words

    def weak(*args):
        w = real(*args)
        w.hash[:] = w.hash % np.uint64(5)
        return w

    monkeypatch.setattr(textbytes, "words", weak)
    made = tokens.PieceEncoder(PATH, remembered)
    for texts in (["one two three", "four"], ["five one", "é seventy-seven four", "one " + "x" * 90 + " " + "x" * 89 + "y"], ["three two one", "", "five six"]):
        assert [[*x.tolist(), 2] for x in made.encode(pa.array(texts))] == plain_ids(texts)


def test_differ_compares_every_byte():
    rng = np.random.default_rng(0)
    for size in (1, 7, 8, 9, 64, 65, 200):
        a = rng.integers(0, 256, 3 * size).astype(np.uint8)
        for at in range(size):
            b = a.copy()
            b[size + at] ^= 1
            start, n = np.arange(3) * size, np.full(3, size)
            assert textbytes.differ(a, start, n, b, start, n).tolist() == [False, True, False]
    x = np.zeros(4, np.uint8)
    assert textbytes.differ(x, np.array([0]), np.array([3]), x, np.array([0]), np.array([4])).tolist() == [True]


def test_swapped_texts_are_no_copies(spark):
    a, b = swapped(11, ["up"], ["down"])
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert {(r.id, r.n_copies) for r in jaccard.similar(d).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("parts", [1, 16, 64])
def test_fill_hardly_depends_on_the_number_of_tasks(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(parts)
    rows, texts = packing.pack(docs, PATH).collect(), docs.collect()
    windows = check_pieces(rows, dict(zip([r.doc_id for r in texts], plain_ids([r.text for r in texts]), strict=True)), 4096)
    assert sum(r.length for r in rows) / (4096 * len(windows)) > 0.97


def test_many_tiny_documents_need_little_memory():
    from conftest import ROOT

    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
from drawscope.llm import packing
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
group, done = packing._Group(4096, 0), 0
for i in range(1_000_000):
    group.add(None if i % 3 else i, 0, 1, 5, 1)
    if group.full(192):
        done += group.close().num_rows
done += group.close().num_rows
assert done == 1_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024, group.first)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
    assert int(out[-2]) < 300 and int(out[-1]) <= 250


def test_bundles_hold_neighbours_only_where_both_are_small():
    sizes = np.array([1] * 300 + [700, 2, 128, 126, 3])
    got = packing.bundles(sizes, 4096)
    sums = np.bincount(got, weights=sizes)
    assert sums.sum() == sizes.sum() and np.bincount(got)[got[300]] == 1 and np.bincount(got)[got[302]] == 1
    assert sums[got[0]] < 256
