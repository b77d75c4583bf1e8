"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.llm import bpe, chat, decontamination, embeddings, html, lexical, merkle, packing, secrets, sharding, simhash, toxicity, warc


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT r, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, folder, "documents"))


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    message = lambda role: F.struct(F.lit(role).alias("role"), said.alias("content"))
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    turns = chat.canonical_turns(_read(spark, folder, "conversations")).unionByName(chat.canonical_turns(own))
    return chat.digests(chat.format_turns(turns))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p')) + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""".replace("\\", "\\")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_rows(_read(spark, folder, "documents"), shards=8, seed=0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(_read(spark, folder, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_read(spark, folder, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.v FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.u = v.vec_id
"""


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(_read(spark, folder, "pages").select("page_id", "url", "html"))


#: What the given pages hold: one article without furniture inside, whose text is wanted whole.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, string_split_regex(h, '</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|pre|table|tr|td|th|figure|figcaption)(?:\s[^>]*)?>') AS parts FROM a),
t AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM b),
u AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS parts FROM t),
w AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM u),
j AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS text FROM w)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""

OP7_SQL = """
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS name, source IS NULL AS none, hex(encode(coalesce(text, ''))) AS h, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
c AS (SELECT r, doc_id, name, none, m, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
      xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32 FROM d, t),
k AS (SELECT *, (2 * (row_number() OVER (PARTITION BY none, name ORDER BY m, doc_id, text_crc32, size) - 1) + 1) / (2 * count(*) OVER (PARTITION BY none, name)) AS share, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY share, none, name || '"', m, doc_id, text_crc32, size) - 1 AS place FROM k)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard, CAST(place - ((place * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    model = toxicity.fit(docs, _read(spark, folder, "labels").where(~toxicity.held_out()))
    scored = toxicity.with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, folder, "documents"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_read(spark, folder, "documents"), tokenizer())


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, folder, "documents"), word_tokenizer(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_tokenizer() -> packing.WordTokenizer:
    import public_tokenizers

    return packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), k=10)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT count(*) AS rows, sum(len(w)) AS total FROM d WHERE len(w) > 0),
qt AS (SELECT q, item_id, t, count(*) AS qn FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
dt AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM dt GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * rows + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, a),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(qn * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * rows) // CAST(total AS BIGINT))))) AS BIGINT) AS score
      FROM qt JOIN dt USING (t) JOIN w USING (t), a GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digests(_read(spark, folder, "documents"))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, n)) AS tab),
f AS (SELECT doc_id, source, coalesce(source, '') AS name, source IS NOT NULL AS named, text, hex(encode(CAST(doc_id AS VARCHAR))) AS h,
      concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
             coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head FROM documents),
c AS (SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc FROM f, t),
d AS (SELECT doc_id, name, named, head || coalesce(octet_length(encode(text)) || ':' || text, '-') AS was,
      head || coalesce(octet_length(encode(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)) || ':' || CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END, '-') AS now FROM c),
l AS (SELECT doc_id, name, named, sha256(was) AS leaf, sha256(now) AS other FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY named, name) AS n FROM l),
g AS (SELECT DISTINCT named, name FROM r),
s AS (SELECT *, row_number() OVER (ORDER BY named, name) - 1 AS k, count(*) OVER () AS m FROM g),
low AS (SELECT k AS tree, 0 AS level, i, leaf AS h, n FROM r JOIN s USING (named, name)
        UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, i // 3, n),
high AS (SELECT 0 AS level, tree AS i, h, (SELECT count(*) FROM s) AS n FROM low WHERE n = 1
         UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, i // 3, n),
node AS (SELECT tree, level, i, h, n FROM low UNION ALL SELECT -1, level, i, h, n FROM high),
side AS (SELECT tree, level, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM node),
climb AS (SELECT r.doc_id, s.k AS home, r.i AS place, s.k AS tree, 0 AS level, r.i, r.other AS h, '' AS path, false AS over FROM r JOIN s USING (named, name)
          UNION ALL SELECT c.doc_id, c.home, c.place, CASE WHEN x.n = 1 THEN -1 ELSE c.tree END, CASE WHEN x.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN x.n = 1 THEN c.tree ELSE c.i // 3 END,
                    CASE WHEN x.n = 1 THEN c.h ELSE sha256(x.before || c.h || x.after) END, CASE WHEN x.n = 1 THEN c.path ELSE c.path || x.before || x.after END, x.n = 1 AND c.tree = -1
          FROM climb c JOIN side x ON x.tree = c.tree AND x.level = c.level AND x.i = c.i WHERE NOT c.over),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT c.doc_id, r.leaf, low.h AS subroot, root.root, sha256(c.path) AS proof_sha256, c.h AS folded_root, c.h = root.root AS verified
FROM climb c JOIN s ON s.k = c.home JOIN r ON r.named = s.named AND r.name = s.name AND r.i = c.place JOIN low ON low.tree = c.home AND low.n = 1, root WHERE c.over
"""


def tokenizer() -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_embeddings": op6_embeddings,
    "op7_sharding": op7_sharding,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_packing": op11_packing,
    "op12_lexical": op12_lexical,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_embeddings": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op9_html": OP9_SQL,
    "op12_lexical": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
