"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, new_path, table
from . import chat, decontam, jaccard, langid, linededup, packing, phrases, quality, repair, sentpiece, tokenfile, topk, urlfilter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MIN_SITES = 10


def remainder(key: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; -1 for a null id, so such a row is not held out and may train."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod, F.lit(-1))


#: Host and path rules of the url filter.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: A conversation that holds the marks of a common template as text.
EXTRA_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"), MIN_SITES)
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_cut").alias("n_removed"), F.md5(F.col("text")).alias("kept_md5"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    tokenfile.write_files(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return tokenfile.read_back(spark, folder)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string")
    done = materialise(chat.format_chats(rows.unionByName(extra)), "chats")
    turns, masked = chat.parse(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    return done.withColumns({"t": turns, "m": masked}).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("m").cast("long").alias("loss_chars"),
        F.sha2(F.col("m"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.fit(urlfilter.by_rules(pages, URL_RULES))
    return urlfilter.judged(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("__hits.spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return marked.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    # Held-out rows are no unlabelled text either.
    scorer = quality.fit(docs.where(remainder("doc_id", 5) != 0), learnt)
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), quality.score_column(docs, scorer).alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> langid.ContextTrees:
    return langid.fit(docs.where(remainder("doc_id", 4) != 2))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = langid.with_language(docs.select("doc_id", "text"), language_model(docs))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(repair.damaged(rows), copies="copies")
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select(*(c for c in done.columns if c != "repaired"), F.sha2(said, 256).alias("repaired_sha256"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("text", "lang"), least=30, top=2000)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentpiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

_REST = r"(/?INST\]|/?ROLE\]|TEXT\]|/?s>|</?SYS>>)"
_ESCAPED = rf"regexp_replace(%s, '([\[<])(\\*){_REST}', '\1\\\2\3', 'g')"

#: A turn conflicts if its closing mark comes early, if another role's name holds the text mark, or
#: if unescaping would change it; those turns are escaped.
OP4_SQL = rf"""
WITH rows AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
marks AS (SELECT *, CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS close,
  CASE role WHEN 'system' THEN '<<SYS>>' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '<s>' END AS open FROM rows),
bodies AS (SELECT *, CASE WHEN open IS NULL THEN role || '[TEXT]' || text ELSE text END AS body,
  CASE WHEN open IS NULL THEN '[ROLE]' || {_ESCAPED % "role"} || '[TEXT]' || {_ESCAPED % "text"} ELSE open || {_ESCAPED % "text"} END || close AS escaped FROM marks),
turns AS (SELECT *, strpos(body || close, close) <= length(body) OR regexp_matches(text, '[\[<]\\+{_REST}')
  OR (open IS NULL AND (strpos(role || '[TEXT]', '[TEXT]') <= length(role) OR regexp_matches(role, '[\[<]\\+{_REST}'))) AS conflict FROM bodies)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(CASE WHEN conflict THEN escaped ELSE coalesce(open, '[ROLE]') || body || close END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, alone
"""

OP2_SQL = f"""
WITH cut AS (SELECT doc_id, coalesce(source, chr(0) || 'null') AS site, text, string_split(text, chr(10)) AS parts FROM documents),
rows AS (SELECT doc_id, site, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut),
lines AS (SELECT doc_id, site, pos, regexp_replace(part, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS line FROM rows),
spread AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS keep FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
gone AS (SELECT l.doc_id, l.pos FROM lines l JOIN spread s ON l.line = s.line WHERE NOT (l.doc_id = s.keep.d AND l.pos = s.keep.p)),
per AS (SELECT r.doc_id, string_agg(r.part, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL) AS kept, count(*) FILTER (l.line <> '') AS n_lines, count(g.pos) AS n_removed
  FROM rows r JOIN lines l ON l.doc_id = r.doc_id AND l.pos = r.pos LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(p.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id
"""

OP6_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
seq AS (SELECT doc_id, ws, array_to_string(ws, ' ') AS q FROM words WHERE len(ws) > 0),
classes AS (SELECT q, min(doc_id) AS rep, count(*) AS n_copies, any_value(ws) AS ws FROM seq GROUP BY q),
grams AS (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM classes),
sh AS (SELECT DISTINCT rep, array_to_string(ws[i:i + 4], ' ') AS g FROM grams),
sizes AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
met AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes s ON s.rep = x JOIN sizes t ON t.rep = y WHERE 10 * c >= 8 * (s.n + t.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT rep, rep FROM classes UNION SELECT s.y, r.root FROM reach r JOIN sides s ON s.x = r.node),
comp AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
deg AS (SELECT x, count(*) AS n_links FROM sides GROUP BY x),
done AS (SELECT s.doc_id, c.class_id, coalesce(d.n_links, 0) AS n_links, k.n_copies FROM seq s JOIN classes k ON k.q = s.q JOIN comp c ON c.node = k.rep LEFT JOIN deg d ON d.x = k.rep)
SELECT d.doc_id, coalesce(x.class_id, d.doc_id) AS class_id, coalesce(x.n_links, 0)::BIGINT AS n_links, coalesce(x.n_copies, 1)::BIGINT AS n_copies FROM documents d LEFT JOIN done x ON x.doc_id = d.doc_id
"""

OP8_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS id, {_WORDS} AS ws FROM benchmark),
starts AS (SELECT id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM starts),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m),
hits AS (SELECT p.doc_id, p.i, p.m, w.id FROM places p JOIN windows w ON w.m = p.m AND w.g = array_to_string(p.ws[p.i:p.i + p.m - 1], ' ')),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits),
counted AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.ws), 0)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  coalesce(n.h, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

#: Best (cost, audit, turns) of each (row, state), row by row; what follows a row are its edit and at most two inserts.
OP11_SQL = r"""
WITH RECURSIVE src AS (SELECT *, dense_rank() OVER (ORDER BY conv_id, alone) AS c FROM (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
hit AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT), lambda s, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[],
    lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(s, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS f FROM src),
dam AS (SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit),
num AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, left(role, 1) AS l, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM num),
rows AS (SELECT c, i, turn, role, text, l, before, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
per AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (i > 1 AND before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
ins(q, q3, cost, audit, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
    (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edits(l, e, q, q2, cost, role) AS (VALUES ('s', 'K', 0, 1, 0, NULL), ('u', 'K', 0, 2, 0, NULL), ('u', 'K', 1, 2, 0, NULL), ('u', 'K', 3, 2, 0, NULL), ('a', 'K', 2, 3, 0, NULL),
    (NULL, 'R', 0, 2, 2, 'user'), (NULL, 'R', 1, 2, 2, 'user'), (NULL, 'R', 3, 2, 2, 'user'), (NULL, 'R', 2, 3, 2, 'assistant'), (NULL, 'D', 0, 0, 3, NULL), (NULL, 'D', 1, 1, 3, NULL), (NULL, 'D', 2, 2, 3, NULL), (NULL, 'D', 3, 3, 3, NULL)),
best(c, i, q, b) AS (SELECT c, 0::BIGINT, q3, {'cost': cost, 'audit': audit, 'said': said} FROM (SELECT DISTINCT c FROM src), ins WHERE q = 0
  UNION ALL
  SELECT n.c, n.i + 1, s.q3, min({'cost': n.b.cost + e.cost + s.cost + CASE WHEN r.cut AND e.e <> 'D' THEN 1 ELSE 0 END, 'audit': n.b.audit || e.e || s.audit,
      'said': list_concat(n.b.said, CASE e.e WHEN 'D' THEN [] ELSE [coalesce(e.role, r.role) || ':' || r.text] END, s.said)})
  FROM best n JOIN rows r ON r.c = n.c AND r.i = n.i + 1 JOIN edits e ON e.q = n.q AND (e.l IS NULL OR e.l = r.l) AND (e.e = 'D' OR NOT (r.blank OR r.dup)) JOIN ins s ON s.q = e.q2 GROUP BY n.c, n.i, s.q3),
ends AS (SELECT b.c, min(b.b) AS b FROM best b LEFT JOIN per p ON p.c = b.c WHERE b.i = coalesce(p.n, 0) AND b.q IN (0, 3) GROUP BY b.c),
ids AS (SELECT DISTINCT c, conv_id FROM src)
SELECT ids.conv_id, coalesce(p.gaps, 0)::BIGINT AS gaps, coalesce(p.blank, 0)::BIGINT AS blank, coalesce(p.duplicate, 0)::BIGINT AS duplicate, coalesce(p.truncated, 0)::BIGINT AS truncated,
  coalesce(p.illegal, 0)::BIGINT AS illegal, e.b.cost::BIGINT AS cost, e.b.audit AS audit, sha256(array_to_string(e.b.said, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN per p ON p.c = ids.c JOIN ends e ON e.c = ids.c
"""

OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM cut GROUP BY lang),
found AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3), (4)) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM found GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT s.*, j, x.a AS l, y.a AS r, 2000000::HUGEINT * s.a // (x.a + y.a) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM split) s
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(ws[:j], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, min({'score': score, 'j': j, 'l': l, 'r': r}) AS b FROM cuts GROUP BY ALL),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM split, (VALUES (2), (3)) t(m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.a IS NULL OR 100::HUGEINT * x.a < 80::HUGEINT * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY b.score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY b.score DESC, a DESC, phrase) <= 2000
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_top_k, op2_line_dedup, op3_token_files, op4_chat_formatting, op5_url_filter, op6_ngram_jaccard_join, op7_packing, op8_decontamination, op9_quality, op10_language_id, op11_conversation_repair, op12_phrase_mining, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op2_line_dedup": OP2_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op8_decontamination": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_phrase_mining": OP12_SQL}
