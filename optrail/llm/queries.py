"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .caps import link_near
from .chunks import dedup_substrings
from .common import read_table
from .html import extract_main_text
from .jaccard import join_near
from .mih import search
from .mix import mix_sources
from .mixing import score_texts
from .perplexity import judge
from .runs import find_runs
from .sweep import open_sales, sweep
from .toxicity import Lexicon, learn_lexicon, score_toxicity
from .warc import round_trip


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_chunks", "removed_bytes", "spans", "copied_from", "text")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), fold_of() == 1)


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_texts(docs.select("doc_id", "text"), path, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def fold_of():
    """crc32 of doc_id as text, modulo 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def toxicity_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Lexicon:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of() != 0)
    return learn_lexicon(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_lexicon(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "hits")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(read_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(read_table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "digest_ok")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words; in a tenth of the documents, told by a checksum of the id, all from one place on repeat the first of them."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "level")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(read_table(spark, sf_dir, "documents"), edit=repeating)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return found.select("doc_id", "n_words", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(open_sales(*(read_table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients"))))


QUERIES = {"op1_mih": op1_mih, "op2_chunks": op2_chunks, "op3_mix": op3_mix, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_bpe": op6_bpe, "op7_html": op7_html, "op8_caps": op8_caps, "op9_warc": op9_warc, "op10_jaccard": op10_jaccard, "op11_perplexity": op11_perplexity, "op12_runs": op12_runs, "op13_sweep": op13_sweep}

ORACLES: dict[str, str] = {}

_OP3_WEIGHTS = "list_extract([3.0, 1.0, 2.0]::DOUBLE[], (((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1)::INT)"

ORACLES["op3_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, {_OP3_WEIGHTS} AS weight FROM sizes),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS full_size, source_size * 2.0::DOUBLE / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM weighted),
filled AS (
  SELECT *, (budget - coalesce(sum(full_size) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS own_level FROM levels
  WINDOW w AS (ORDER BY level, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(level) AS cut_level, arg_min(own_level, {{'level': level, 'below': -own_level}}) AS own FROM filled WHERE level > own_level),
targets AS (
  SELECT f.source, source_size, weight, CASE WHEN cut_level IS NULL OR level < cut_level THEN full_size ELSE least(full_size, weight * own) END AS target
  FROM filled f CROSS JOIN cut),
placed AS (
  SELECT d.doc_id, d.size, d.draw, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS reached
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT *, (reached + nth * source_size - size / 2.0::DOUBLE) / target AS finish FROM placed, (VALUES (0), (1)) r(nth) WHERE size > 0 AND target > 0),
queue AS (SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id NULLS FIRST, size, nth ROWS UNBOUNDED PRECEDING) AS served FROM entries),
kept AS (
  SELECT doc_id, sum(size) AS taken FROM queue WHERE served - size / 2.0::DOUBLE < (SELECT sum(target) FROM targets) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM placed p LEFT JOIN kept k ON p.doc_id IS NOT DISTINCT FROM k.doc_id
"""

ORACLES["op9_warc"] = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
hashed AS (SELECT page_id, payload_bytes, sha1(body) AS hex FROM sized),
coded AS (SELECT page_id, payload_bytes, hex, list_reduce(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), lambda a, b: a || b) AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN true END AS digest_ok
FROM firsts
"""

ORACLES["op10_jaccard"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reach.other FROM reach JOIN links ON links.x = reach.doc_id)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLES["op8_caps"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.y, reach.other FROM reach JOIN links ON links.x = reach.vec_id),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT r.vec_id, coalesce(any_value(d.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept FROM reach r LEFT JOIN degrees d ON d.x = r.vec_id GROUP BY r.vec_id
"""

# The checksum bit by bit; pairs of equal words at a distance, stretches of them, and of those the ones with no shorter period.
ORACLES["op12_runs"] = """
WITH listed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::BIGINT, 1))::UBIGINT)), lambda c, b:
      list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)::BIGINT AS h FROM documents),
sized AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS edited FROM listed),
placed AS (SELECT *, CASE WHEN edited THEN g % n END AS a FROM sized),
edited AS (SELECT *, CASE WHEN edited THEN 1 + (n - a) // (3 + g % 8) END AS p FROM placed),
words AS (SELECT doc_id, i, CASE WHEN edited AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM edited)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
periodic AS (SELECT doc_id, q, min(i) AS s, min(i) + count(*) + q AS e FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT * FROM periodic r WHERE NOT EXISTS (SELECT 1 FROM periodic z WHERE z.doc_id = r.doc_id AND z.q < r.q AND r.q % z.q = 0 AND z.s <= r.s AND z.e >= r.e)),
listing AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
  arg_max({'s': s, 'l': e - s, 'q': q}, {'l': e - s, 's': -s, 'q': -q}) AS best FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM sized d LEFT JOIN listing r ON r.doc_id = d.doc_id LEFT JOIN left_over k ON k.doc_id = d.doc_id
"""

ORACLES["op13_sweep"] = """
WITH shipped AS (SELECT sale_id, min(floor(epoch_us(shipped_at) / 60000000.0)::BIGINT * 60) + 604800 AS to_s FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id),
nations AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
open_from AS (SELECT coalesce(n.nation_id, -1) AS nation_id, floor(epoch_us(s.sold_at) / 60000000.0)::BIGINT * 60 AS from_s, h.to_s, coalesce(floor(100 * s.total + 0.5), 0)::BIGINT AS cents
  FROM sales s LEFT JOIN shipped h ON h.sale_id = s.sale_id LEFT JOIN nations n ON n.client_id = s.client_id WHERE s.sold_at IS NOT NULL),
whole AS (SELECT * FROM open_from WHERE to_s IS NULL OR to_s > from_s),
both_groups AS (SELECT * FROM whole UNION ALL SELECT -2, from_s, to_s, cents FROM whole),
ends AS (SELECT nation_id, from_s, 1 AS n, cents FROM both_groups UNION ALL SELECT nation_id, to_s, -1, -cents FROM both_groups WHERE to_s IS NOT NULL),
changes AS (SELECT nation_id, from_s, sum(n) AS n, sum(cents) AS cents FROM ends GROUP BY nation_id, from_s HAVING sum(n) <> 0 OR sum(cents) <> 0),
running AS (SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, sum(n) OVER w AS n_open, sum(cents) OVER w AS open_cents FROM changes WINDOW w AS (PARTITION BY nation_id ORDER BY from_s))
SELECT nation_id::INT AS nation_id, from_s, to_s, n_open::BIGINT AS n_open, open_cents::BIGINT AS open_cents,
  (max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s))::BIGINT AS high_open, open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak FROM running
"""
