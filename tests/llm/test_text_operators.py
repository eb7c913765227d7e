"""Word-level operators against plain ones."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drawscope.llm import decontam, jaccard, langid, linededup, quality, textbytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "  \n\n", "été", "ÉTÉ été", "a", "x" * 5000 + " y", "日本語 テスト", "A-b_c9"]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def test_words_match_the_pattern():
    for _, _, data, offsets in textbytes.chunks(pa.array(ODD), 10):
        w = textbytes.words(data, offsets)
        for t in range(len(offsets) - 1):
            raw = data[offsets[t] : offsets[t + 1]].tobytes().decode()
            got = [textbytes.LOWER[data[a:b]].tobytes().decode() for a, b in zip(w.start[w.first[t] : w.first[t + 1]], w.end[w.first[t] : w.first[t + 1]], strict=True)]
            assert got == words(raw)


def test_equal_words_hash_alike_wherever_they_stand():
    texts = pa.array(["one two", "xx TWO", "three two one"])
    found = defaultdict(set)
    for limit in (3, 1 << 20):
        for _, _, data, offsets in textbytes.chunks(texts, limit):
            w = textbytes.words(data, offsets)
            for a, b, h in zip(w.start, w.end, w.hash, strict=True):
                found[textbytes.LOWER[data[a:b]].tobytes()].add(int(h))
    assert all(len(v) == 1 for v in found.values()) and len({next(iter(v)) for v in found.values()}) == 4


def brute_hits(docs, items, span=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(span, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[a : a + m])].add(i)
    out = []
    for d in docs:
        w, hit, found = words(d), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if (k := tuple(w[a : a + m])) in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def benchmark_case():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(str(i), text(n)) for i, n in enumerate([25, 10, 11, 9, 3, 1, 40])] + [("8", None), ("9", "!!"), ("10", "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = [*ODD, "w1 " * 30, *(text(60) for _ in range(30))]
    for k, (_, t) in enumerate(items):
        if t:
            docs.append(f"{text(5)} {t.upper()}! {text(7)}")
            docs.append(" ".join(t.split()[: 9 + k % 3]))
    return docs, items


def test_winnowing_finds_every_shared_window():
    docs, items = benchmark_case()
    index = decontam.build_index(items)
    got = []
    for _, _, data, offsets in textbytes.chunks(pa.array(docs), 700):
        n, spans, found = decontam.mark(index, data, offsets)
        got += [(int(a), sum(hi - lo for lo, hi in s), sorted(f)) for a, s, f in zip(n, spans, found, strict=True)]
    assert got == brute_hits(docs, items)


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_decontamination_in_one_or_many_blocks(spark, block_chars):
    docs, items = benchmark_case()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = decontam.decontaminate(d, b, block_chars=block_chars).orderBy("doc_id").collect()
    got = [(r["__hits"].n_words, sum(s.hi - s.lo for s in r["__hits"].spans), list(r["__hits"]["items"])) for r in rows]
    assert got == brute_hits(docs, items) and rows[0].item_id == "clash"
    assert hashlib.sha256(b"").hexdigest() == decontam.digest([])


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.decontaminate(one, b).first()["__hits"].n_words == 2


def brute_classes(rows, threshold=0.8):
    """(class, links, copies) by id, from all pairs of texts."""
    groups = defaultdict(list)
    for i, t in rows:
        w = words(t)
        if w:
            groups[tuple(w)].append(i)
    keys = list(groups)
    sets = [{k[a : a + 5] for a in range(max(1, len(k) - 4))} for k in keys]
    root = list(range(len(keys)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, k in enumerate(keys):
        least[find(a)] += [i for i in groups[k] if i is not None]
    out = []
    for i, t in rows:
        k = tuple(words(t))
        a = keys.index(k) if k else None
        out.append((i, i, 0, 1) if a is None else (i, min(least[find(a)], default=None), links[a], len(groups[k])))
    return out


def near_copies(seed=5, n=60):
    rng = np.random.default_rng(seed)
    text = lambda m: [f"t{x}" for x in rng.integers(0, 4000, m)]
    rows, i = [], 0
    common = text(12)
    for _ in range(n):
        base = text(int(rng.integers(30, 90)))
        if rng.random() < 0.5:
            base = common + base
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = f"z{rng.integers(0, 9)}"
            rows.append((i, " ".join(copy)))
            i += 1
    base = text(80)
    for _ in range(40):  # one large group of near copies
        copy = list(base)
        copy[int(rng.integers(0, 80))] = f"q{i}"
        rows.append((i, " ".join(copy)))
        i += 1
    rows += [(i + k, t) for k, t in enumerate(["", None, "!!", "one two", "ONE two", "one two", "one two three"])]
    return rows + [(None, "one two"), rows[0]]


@pytest.mark.parametrize("options", [{}, {"limit": 6, "block": 4, "block_weight": 300}])
def test_join_equals_all_pairs(spark, options):
    rows = near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("doc", F.lit("clash"))
    order = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.id, r.class_id, r.n_links, r.n_copies) for r in jaccard.similar(d, **options).collect()), key=order)
    want = brute_classes(rows)
    assert got == sorted(want, key=order)
    kept = jaccard.keep_one(d, **options)
    single = [i for (i, t) in rows if not words(t)]
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == sorted([*{c for (i, t), (_, c, _, _) in zip(rows, want, strict=True) if words(t)}, *single], key=lambda i: (i is None, i))
    assert kept.columns == d.columns


def test_join_of_an_empty_table(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.999)
    assert jaccard.least_agreeing(20, 0.9999) < 16


def brute_lines(rows, min_sites):
    """Texts of (id, text, site) rows, in their order; the first of equal ids and texts counts as the first row."""
    sites, first = defaultdict(set), {}
    for n, (i, t, s) in enumerate(rows):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            bare = line.strip(" \t\r")
            if bare:
                sites[bare].add(s)
                first[bare] = min(first.get(bare, (True, 0, n, p)), (i is None, i or 0, n, p))
    out = []
    for n, (i, t, _) in enumerate(rows):
        if t is None:
            out.append((i, None))
            continue
        kept = [line for p, line in enumerate(t.split("\n")) if not (line.strip(" \t\r") and len(sites[line.strip(" \t\r")]) >= min_sites and first[line.strip(" \t\r")] != (i is None, i or 0, n, p))]
        out.append((i, "\n".join(kept)))
    return out


def test_line_dedup_equals_exact_counts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        lines = [f"line {x}" for x in rng.zipf(1.4, int(rng.integers(0, 9))) % 50] + ["", "  menu \t"] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(lines), f"s{rng.integers(0, 14)}"))
    rows += [(300, None, "s1"), (301, "", None), (302, "  menu\n", None), (None, "menu\nline 1", "s2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("cut", F.lit("x"))
    for least in (1, 5, 10, 14):
        got = linededup.dedup_lines(d, least)
        order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=order) == sorted(brute_lines(rows, least), key=order)
        assert got.columns[: len(d.columns)] == d.columns
    assert linededup.dedup_lines(d.limit(0)).count() == 0


def test_hundreds_of_languages_and_a_bounded_sample(spark):
    rows = [(n * 3 + k, f"{chr(0x4E00 + n)}{chr(0x4E00 + n)} {chr(0x4E00 + n)}" * (k + 1), f"l{n:03}") for n in range(260) for k in range(3)]
    rows += [(None, "zz zy", "hot")] * 500 + [(5, "q" * 5000, "long")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("row", "found", "h", "l")})
    model = langid.fit(d, max_bytes=262 * 40)
    assert len(model.languages) == 262
    got = langid.with_language(d.dropDuplicates(["lang"]), model).collect()
    assert all(r.lang == r.lang_pred for r in got) and got[0].row == "clash"
    assert langid.predict(langid.train({"a": ["xx"], "b": ["xx"]}), pa.array(["xx"]))[0] == ["a"]


def test_language_model_code_lengths_are_exact(monkeypatch):
    texts = {"aa": ["abab abba", "baab"], "bb": ["bcbc cbbc", ""]}
    model = langid.train(texts, order=2)

    def bits(language, text):
        grams = [defaultdict(lambda: defaultdict(int)) for _ in range(3)]
        for t in texts[language]:
            s = ["^"] * 2 + list(t.encode())
            for at in range(2, len(s)):
                for k in range(3):
                    grams[k][tuple(s[at - k : at])][s[at]] += 1
        total, s = 0.0, ["^"] * 2 + list(text.encode())
        for at in range(2, len(s)):
            for k in (2, 1, 0):
                seen = grams[k].get(tuple(s[at - k : at]))
                if not seen:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if s[at] in seen:
                    total += np.log2((n + kinds) / seen[s[at]])
                    break
                total += np.log2((n + kinds) / kinds)
            else:
                total += 8
        return total

    probes = ["ab", "", "bcb abx", "é", "cccc", "b"]
    for _, _, data, offsets in textbytes.chunks(pa.array(probes)):
        got = langid.code_lengths(model, data, offsets)
    want = [[bits("aa", t), bits("bb", t)] for t in probes]
    assert got == pytest.approx(np.array(want), abs=1e-9)
    for stretch, remembered in ((1, 1 << 20), (3, 16), (4, 64)):  # many stretches, and a table that overflows
        monkeypatch.setattr(langid, "STRETCH", stretch)
        monkeypatch.setitem(langid._ready, model.key, langid.Costs(model, remembered))
        assert langid.code_lengths(model, data, offsets) == pytest.approx(np.array(want), abs=1e-9)


def test_language_of_odd_texts_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held))
    rows = langid.with_language(docs.where(held).withColumn("score", F.lit(9)), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = langid.with_language(spark.createDataFrame([(t,) for t in ["", None, "12 ..", "\n"]], "text string"), model).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    noise = bytes(np.random.default_rng(0).integers(0x4E00, 0x9000, 400).astype("<u2").tobytes()).decode("utf-16-le")
    r = langid.with_language(spark.createDataFrame([(noise,)], "text string"), model).first()
    assert r.lang_bits > 8 and all(x.lang_bits < 5 for x in rows)
    none = langid.fit(docs.limit(0))
    assert langid.with_language(docs.limit(3), none).first().lang_pred == "und"


def test_quality_learns_from_positives_and_unlabelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    scorer = quality.fit(docs.where(learn), labels.where(learn).withColumn("text", F.lit("clash")))
    held = docs.where(~learn).join(labels, "doc_id").select("quality", quality.score_column(docs, scorer).alias("s")).collect()
    assert sum((r.s >= 0.3) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([("",), (None,), ("x" * 100000,)], "text string")
    assert all(0 <= r.s <= 1 for r in odd.select(quality.score_column(odd, scorer).alias("s")).collect())
    assert quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros((0, len(quality.FEATURES)))).scores(np.zeros((1, len(quality.FEATURES))))[0] > 0.99


def test_statistics_are_those_of_whole_texts():
    texts = ["Ab ab!  1", "", "x y x y x y", "Éa|b\n"]
    x = {n: c for n, c in zip(quality.FEATURES, quality.statistics(pa.array(texts)).T, strict=True)}
    assert x["upper"][0] == pytest.approx(1 / 9) and x["digit"][0] == pytest.approx(1 / 9) and x["shout"][0] == pytest.approx(1 / 9)
    assert x["distinct"].tolist() == pytest.approx([2 / 3, 0, 1 / 3, 1]) and x["repeated pair"][2] == pytest.approx(4 / 6) and x["repeated"][0] == pytest.approx(1 / 3)
    assert x["line"][3] == pytest.approx(1 / 6) and x["upper of letters"][3] == 0
