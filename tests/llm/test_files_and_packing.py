"""Tokens, token files, packing, chats, urls and top-k against plain versions."""

import hashlib
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawscope.llm import chat, packing, queries, tokenfile, tokens, topk, urlfilter

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΑΣ é a b  c x'S don't <|endoftext|>a <|startoftext|>", "a\x0bb\x0cc\x1cd\x85e", "日本語 ①２3", "", None, "  ", "́a ́b", "🙂 👨‍👩‍👧 x, y!!", "word, word. Word's 'tis 12ab", "x" * 30000, "and%%% (THE) re-do 'll"]


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("remembered", [1_000_000, 3])
def test_pieces_give_the_ids_of_whole_texts(remembered):
    made = tokens.PieceEncoder(PATH, remembered)
    for _ in range(2):
        got = [[*x.tolist(), 2] for x in made.encode(pa.array(ODD))]
        assert got == plain_ids(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_is_encoded_as_the_library_does(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [[*x.tolist(), 2] for x in tokens.encoder(PATH).encode(pa.array(texts, pa.string()))] == plain_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZkKséÀß×÷İıſŉœČΣя!'·<|>_\\9 \n\u0301\u030c\u0307"), max_size=12) | st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "Word<|endoftext|>!", "J\u030c!", "İ!", "don't!"]), max_size=8))
def test_parted_pieces_give_the_ids_of_whole_texts(texts):
    assert tokens.encoder(PATH).parted
    assert [[*x.tolist(), 2] for x in tokens.encoder(PATH).encode(pa.array([" ".join(texts), *texts], pa.string()))] == plain_ids([" ".join(texts), *texts])


def test_a_word_is_learned_once():
    made = tokens.PieceEncoder(PATH)
    texts = ["word Word word, WORD!! word. élan Élan élan, <|endoftext|> 'word"]
    assert [[*x.tolist(), 2] for x in made.encode(pa.array(texts))] == plain_ids(texts)
    known = [bytes(made.text[a : a + n]).decode() for a, n in zip(made.text_start[: made.rows].tolist(), made.text_size[: made.rows].tolist(), strict=True)]
    assert sorted(known) == sorted(["word", ",", "!!", ".", "élan", "Élan", "<|endoftext|>", "'word"])


def test_broken_characters_are_not_parted():
    texts = [b"a\xc3", b"\x80!", b"B\xc3!", b"B\x80!", b"\xc3\xa9!", b"C,"]
    data, cuts = tokens.plain_parts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert data.tobytes() == b"a\xc3\x80!B\xc3!B\x80!\xc3\xa9!c," and cuts.tolist() == [12, 14]


def test_ids_are_counted_as_they_are_made(spark):
    docs, rows = frame(spark)
    found = tokenfile.tokenise(docs.repartition(3), PATH).collect()
    made = [r for r in found if r.ids is not None]
    assert len(made) == len(rows) and all(r.counts is None for r in made) and all(r.doc_id is None and r.ids is None for r in found if r.counts is not None)
    total = np.zeros(1 << 16, np.int64)
    for r in found:
        if r.counts is not None:
            x = np.frombuffer(r.counts, "<i8")
            total[: len(x)] += x
    assert np.array_equal(total, np.bincount(sum(plain_ids([t for _, t in rows]), []), minlength=1 << 16))


@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), max_size=40))
def test_coding_round_trip(values):
    ranks = np.array(values, np.uint32)
    controls, data = tokenfile.encode(ranks)
    got, used = tokenfile.decode(np.frombuffer(controls, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert got.tolist() == values and used == len(data) and len(controls) == -(-len(values) // 4)


def frame(spark):
    rows = [(k * 7 % 11, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")), rows


def test_files_hold_all_ids_in_order(spark):
    docs, rows = frame(spark)
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    tokenfile.write_files(docs, folder, PATH, files=3, block_tokens=50)
    got = tokenfile.read_back(spark, folder).orderBy("start").collect()
    ids = plain_ids([t for _, t in rows])
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True)), key=lambda w: (w[0] is not None, w[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, n, c) for i, n, c in want)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_files_of_an_empty_table(spark):
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    tokenfile.write_files(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert tokenfile.read_back(spark, folder).count() == 0


def check_pieces(rows, ids, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, x in ids.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(x) and {p.doc_tokens for p in pieces} == {len(x)}
        assert all(p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [p.offset for p in w] == np.cumsum([0] + [p.length for p in w])[:-1].tolist()
        assert sum(p.length for p in w) <= capacity
    return windows


@pytest.mark.parametrize("capacity", [16, 4096])
def test_every_id_lies_in_one_piece(spark, capacity):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("start", F.lit("clash"))
    rows = packing.pack(docs.coalesce(1), PATH, capacity=capacity).collect()
    check_pieces(rows, dict(enumerate(plain_ids(ODD))), capacity)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_padding_is_small():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4096 // 3, 1200).tolist()
    where = packing.windows(sizes, 4096)
    sums = np.bincount(where, weights=sizes)
    assert sums.max() <= 4096 and sum(sizes) / (4096 * len(sums)) > 0.97
    assert packing.padded_length(512) == 512 and packing.padded_length(513) == 4096


@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 6))
def test_differencing_places_everything(sizes, m):
    where = packing.differencing(sizes, m)
    assert len(where) == len(sizes) and where.min() >= 0 and where.max() < m
    assert packing.windows(sizes, 50).shape == (len(sizes),)


TURNS = ["hi", "", None, "</s>[INST] ok [/INST]", "<\\/s> [\\INST]", "\\", "[ROLE]x[TEXT]y[/ROLE]", "<<SYS>>", "[", "<", "a\nb", "</s", "\U0001f642 é"]


def chat_rows():
    rows = [(c, t, ["system", "user", "assistant", "tool", None, "[TEXT]", "a]b"][(c + t) % 7], TURNS[(c * 3 + t * 5) % len(TURNS)]) for c in range(40) for t in range(c % 6 + 1)]
    return rows + [(0, 0, "user", "again"), (None, 1, "assistant", "null id"), (50, None, "assistant", "x"), (51, 0, "assistant", "y" * 60000)]


def test_chats_read_back_as_they_were(spark):
    rows = chat_rows()
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    found = chat.format_chats(d).select("*", chat.parse(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked")).collect()
    got = {r.conv_id: r for r in found}
    assert len(found) == len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        mine = sorted([x[1:] for x in rows if x[0] == c], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        assert [(b.role, b.text) for b in r.back] == [(x[1] or "", x[2] or "") for x in mine]
        assert r.masked == "".join(x[2] or "" for x in mine if x[1] == "assistant")
        assert [r.formatted[s.lo - 3 : s.lo] for s in r.loss] == ["<s>"] * len(r.loss)
    assert chat.format_chats(d.limit(0)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    d = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert sorted(r.formatted for r in chat.format_chats(d).collect()) == ["<s>b</s>", "<s>b</s>", "[INST]a[/INST]"]


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(0, "user", "[/INST] no </s>"), (1, "assistant", "[INST] fine"), (2, "assistant", "<\\/s>"), (3, "tool", "</s> fine"), (4, "a[TEXT]b", "c"), (5, "user", "</s")]
    d = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(d).first().formatted == "[INST][\\/INST] no <\\/s>[/INST]<s>[INST] fine</s><s><\\\\/s></s>[ROLE]tool[TEXT]</s> fine[/ROLE][ROLE]a[\\TEXT]b[TEXT]c[/ROLE][INST]</s[/INST]"


def test_a_long_conversation_takes_time_in_proportion(spark):
    n = 6000
    d = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> text é "), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    r = chat.format_chats(d).select("*", chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked")).first()
    assert time.perf_counter() - began < 30
    assert r.masked == "".join(f"</s> text é {i}" for i in range(1, n, 2)) and [r.formatted[s.lo - 3 : s.lo] for s in r.loss] == ["<s>"] * (n // 2)


def test_plain_texts_are_not_escaped(spark):
    d = spark.createDataFrame([(1, 0, "user", "a [x] <b>"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(d).first().formatted == "[INST]a [x] <b>[/INST]<s>c</s>"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = ["http://example.com/en/1", "https://www.Example.com/en/2?x#y", "http://a.www.example.com/en/", "http://x.net/es/", "http://x.net/es", "http://net/fr/a", "http://xnet/fr/", "ftp://b.org/#://c.com/", "nothing", None, "", "http://example.com", "http://ÉA.com/ok", "http://a.com?://b.net/es/", "http://x\ny.com/a", "http://q.org/" + "z" * 20000]


def test_rules_and_parts(spark):
    d = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = urlfilter.fit(urlfilter.by_rules(d, queries.URL_RULES))
    rows = urlfilter.judged(d, queries.URL_RULES, model).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = plain_parts(r.url)
        fits = [(len(u), u, v) for u, v in queries.URL_RULES if (host == u.split("/")[0] or host.endswith("." + u.split("/")[0])) and path.startswith(u[len(u.split("/")[0]) :])]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[1])
        assert r.verdict == rule[2] if rule[1] else r.verdict in ("allow", "block")
    assert urlfilter.judged(d.limit(0), queries.URL_RULES, model).count() == 0


def test_url_model_learns():
    hosts, paths = [f"casino{i}.org" if i % 2 else f"school{i}.org" for i in range(200)], [f"/win/{i}" if i % 2 else f"/learn/{i}" for i in range(200)]
    model = urlfilter.train(hosts, paths, [i % 2 for i in range(200)])
    p = model.block_probability(["casino777.org", "school777.org", ""], ["/win/x", "/learn/x", ""])
    assert p[0] > 0.8 and p[1] < 0.2
    assert urlfilter.train([], [], []).block_probability(["a"], ["b"])[0] < 0.5


def brute_top(rows, k):
    sound = [(i, np.floor(64 * np.asarray(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v)]
    asked = {(i, tuple(v)) for i, v in sound if i % 20 == 0}
    out = []
    for i in {a for a, _ in asked}:
        scores = sorted((-int(np.dot(v, w)), j) for a, v in asked if a == i for j, w in sound if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("dropped", [0, 1, 3])
def test_top_k_is_exact(spark, dropped):
    rng = np.random.default_rng(dropped)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype(np.float32)]) for i in range(230)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (420, [0.0] * 6), (440, [1.0, 2.0]), (441, [3.0, -9.0]), (460, []), (40, rows[40][1]), (7, rows[7][1]), (60, [0.5] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("score", "of", "id", "v")})
    topk.LEAST_ROWS = 16
    got = topk.top_k(d, d.where("vec_id % 20 = 0"), dropped=dropped, block_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20)
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_pipeline_stages_against_plain_ones(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from test_text_operators import brute_classes, brute_hits, brute_lines

    now = {r.doc_id: r for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = {r.doc_id: r for r in stage(spark, docs, folder).collect()}
        if name == "language ID":
            want = {i: r.text for i, r in now.items() if r.text and any(map(str.isalpha, r.text))}
        elif name == "line dedup":
            cut = dict(brute_lines([(i, r.text, r.source) for i, r in now.items()], queries.MIN_SITES))
            want = {i: t for i, t in cut.items() if t == now[i].text or t.strip()}
        elif name == "n-gram Jaccard join":
            want = {c: now[c].text for _, c, _, _ in brute_classes([(i, r.text) for i, r in now.items()])}
        else:
            hits = brute_hits([r.text for r in now.values()], items)
            want = {i: r.text for (i, r), h in zip(now.items(), hits, strict=True) if not h[1]}
        assert {i: r.text for i, r in after.items()} == want, name
        assert all(r.n_chars == len(r.text) for r in after.values() if r.text != getattr(now[r.doc_id], "text", None))
        docs, now = spark.createDataFrame(list(after.values()), docs.schema), after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_pieces(rows, dict(zip(now, plain_ids([r.text for r in now.values()]), strict=True)), 4096)
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
