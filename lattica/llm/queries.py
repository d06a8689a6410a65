"""The queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, infill, media, mixing, neighbours, phrases, quality, secrets, simhash, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(*media.store(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.train(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(_table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secrets.BASE_RULES)]
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list("spans").alias("spans"))


def _count(kind: int):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "host", "path", "evidence", "host_share", "path_share", "quality", "keep")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digests(chat.format_chats(chats))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_toxicity, op3_fingerprint, op4_substring, op5_simhash, op6_mixing, op7_secrets, op8_quality, op9_chat, op10_bpe, op11_neighbours, op12_infill, op13_phrases)}


_SIZES = r"""SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(text) AS held,
  row_number() OVER (PARTITION BY doc_id, text, lang, source) - 1 AS among FROM documents"""

OP6_SQL = f"""
WITH RECURSIVE sized AS ({_SIZES}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) AS k
  FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, 3 * source_size AS most, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
rounds AS (
  SELECT 0 AS step, source, source_size, most, weight, false AS is_full FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, most, weight, is_full OR rest_total * weight >= most * rest_weight
  FROM (
    SELECT *, sum(source_size) OVER () - coalesce(sum(most) FILTER (is_full) OVER (), 0) AS rest_total,
      coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0) AS rest_weight
    FROM rounds)
  WHERE step < 40),
last AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) FILTER (is_full) OVER (), 0) AS rest_total,
    coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0) AS rest_weight
  FROM rounds WHERE step = 40),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE (rest_total * weight)::DOUBLE / rest_weight::DOUBLE END AS target FROM last),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(sized.source, 'null') || ':' || coalesce(held, 'null') || ':' || among), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rated
"""


OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS k FROM documents),
windows AS (SELECT k, doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS held FROM (SELECT k, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)),
repeated AS (SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY held) AS first FROM windows) WHERE first < doc_id),
covered AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS place FROM repeated),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
  FROM (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts) ANTI JOIN covered USING (k, place) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (k)
"""

_ESCAPED = "length(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))"
OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len('<s>[TURN]  [/TURN] </s>') + 1} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars, false AS rewrites
FROM turns GROUP BY conv_id
"""


def _op7_sql() -> str:
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.java.replace("'", "''") + "'"
        parts.append(
            f"SELECT k, {k} AS kind, '{rule.kind}' AS name, regexp_split_to_array(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS found, regexp_extract_all(text, {pattern}, {rule.group}) AS value, {rule.least} AS least FROM texts WHERE regexp_matches(text, {pattern})"
        )
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE_RULES))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT k, kind, name, found, value, least, i, list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches)),
spans AS (SELECT k, kind, start, name || ':' || start::BIGINT || ':' || (start + length(found[i]))::BIGINT AS span FROM placed WHERE length(value[i]) >= least),
per_text AS (SELECT k, {counts}, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {base}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY k)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_text USING (k)
"""


OP11_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON a = vec_id
"""

OP12_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM texts),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
pieces AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(units[1 : least(one, two)], ''), '') AS p, coalesce(array_to_string(units[least(one, two) + 1 : greatest(one, two)], ''), '') AS m,
    coalesce(array_to_string(units[greatest(one, two) + 1 :], ''), '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
"""


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
sized AS (SELECT lang, w, i, unnest([1, 2, 3]) AS size FROM runs),
counts AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE i + size - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, w, a, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.w, c.a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR size > 2 OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": OP4_SQL, "op6_mixing": OP6_SQL, "op7_secrets": _op7_sql(), "op9_chat": OP9_SQL, "op11_neighbours": OP11_SQL, "op12_infill": OP12_SQL, "op13_phrases": OP13_SQL}
