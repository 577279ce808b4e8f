"""The operators of this subpackage as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import align, chat, exact, fingerprints, langid, licences, mixing, neardup, pieces, quality, repair, sharding, urlfilter
from corpusmill.llm.common import table

#: Weight of a document in the order of sampling, by its label.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    messages = chat.turns_as_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    chats = chat.format_chats(messages)
    conv = F.when(F.col("tree") != "null", F.substring("tree", 2, 40).cast("long"))
    turns = chat.read_turns(F.col("formatted"))
    told = chats.select(conv.alias("conv_id"), "formatted", turns.alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>)', '<_\1', 'g'), '\|>', '|_>', 'g'), '\[(/?INST\])', '[_\1', 'g'))
          + length(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<_\1', 'g'), '\|>', '|_>', 'g'), '\[(/?INST\])', '[_\1', 'g')) + 10 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), pieces.load(), check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model, cut = urlfilter.calibrated_model(spark)
    return urlfilter.judge_urls(pages, model, cut=cut)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.place(rows, "doc_id", lost=sharding.SHARDS[0])


def _op5_sql() -> str:
    full, rest = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[1:])
    return f"""
SELECT doc_id, n_chars, CAST(slot AS INTEGER) AS slot, printf('shard-%03d', ({full})[slot + 1]) AS shard, printf('shard-%03d', ({rest})[slot + 1] + 1) AS shard_without
FROM (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents)
"""


def label_weights(labels: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(v) for pair in QUALITY_WEIGHT.items() for v in pair])
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).select("doc_id", F.coalesce(F.try_element_at(weight, F.col("quality").cast("int")), F.lit(1.0)).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), quality=label_weights(table(spark, sf_dir, "labels")))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), l AS (
  SELECT doc_id, CASE min(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER lower, 0) AS cap_below, coalesce(sum(w) OVER lower, 0) AS w_below FROM s
  WINDOW lower AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN (total - cap_below) / (all_w - w_below) * w <= cap THEN (total - cap_below) / (all_w - w_below) END) OVER () * w, cap)) AS target FROM c
), k AS (
  SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln((CAST(('0x' || substr(md5('17:' || d.doc_id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(l.w, 1.0), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON d.doc_id = l.doc_id
)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""


def op7_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(i, p) for i, s in licences.SENTENCES.items() for p in licences._pieces(s) if any(a in p.lower() for a in licences.ANCHORS)]
    first = {p: i for i, p in known}
    known = [(i, p) for p, i in first.items()]
    left = "';' || string_agg(sentence_id, ';;' ORDER BY pos) || ';'"
    for licence, sequence in licences.LICENCE_RULES:
        left = f"replace({left}, {quoted(';' + ';;'.join(sequence) + ';')}, '={licence}=')"
    return rf"""
WITH known AS (
  SELECT min(i) AS sentence_id, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS n FROM (VALUES {", ".join(f"({quoted(i)}, {quoted(p)})" for i, p in known)}) AS v(i, s) GROUP BY n
), cut AS (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(?i)SPDX-License-Identifier:[ \t]*', 'SPDX-License-Identifier ', 'g'), '([.!?:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents)
), found AS (
  SELECT doc_id, pos, sentence_id FROM (SELECT doc_id, pos, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS n FROM cut) JOIN known USING (n)
)
, told AS (
SELECT doc_id, count(*) AS n_sentences, string_agg(sentence_id, ',' ORDER BY pos) AS sentence_ids,
  list_distinct(regexp_extract_all({left}, '=([^=;]+)=', 1)) AS l
FROM found GROUP BY doc_id
)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_sort(CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 'proprietary') ELSE l END), ',') AS licences FROM told
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY own) AS group_size, row_number() OVER w = 1 AS kept, sha256(own) AS text_sha256
FROM d WINDOW w AS (PARTITION BY own ORDER BY n DESC, doc_id NULLS LAST)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


#: CRC-32 by its table; then a relaxation row by row over the states n, s, u, a (none, or the role before), of which `w` has the role that is due, and the audit's replay.
OP13_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, list_transform(range(8), lambda x: 0::BIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, poly
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged
), r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (initial || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id
), w AS (
  SELECT * FROM (VALUES ('n', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS v(st, due)
), begin AS (
  SELECT conv_id, 0::BIGINT AS i, st, {'c': c, 'a': a} AS best FROM (SELECT DISTINCT conv_id FROM r), (VALUES ('n', 0::BIGINT, ''), ('u', 2, 'I'), ('a', 4, 'II')) AS v(st, c, a)
), dp AS (
  SELECT * FROM begin
  UNION ALL
  SELECT conv_id, i, st, min(best) AS best FROM (
    SELECT conv_id, i, x.s AS st, {'c': x.c, 'a': x.a} AS best FROM (SELECT conv_id, i, unnest([{'s': st, 'c': c, 'a': a}, {'s': d1, 'c': c + 2, 'a': a || 'I'}, {'s': d2, 'c': c + 4, 'a': a || 'II'}]) AS x FROM (
      SELECT y.conv_id, y.i, y.st, y.c, y.a, w1.due AS d1, w2.due AS d2 FROM (
        SELECT dp.conv_id, dp.i + 1 AS i, m.st, m.c, m.a FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN w ON w.st = dp.st, unnest(list_filter([
          {'st': dp.st, 'c': best.c + 3, 'a': best.a || 'D'},
          CASE WHEN NOT (blank OR dup) THEN {'st': due, 'c': best.c + 2 + CAST(cut AS BIGINT), 'a': best.a || 'R'} END,
          CASE WHEN NOT (blank OR dup) AND (initial = due OR (dp.st = 'n' AND initial = 's')) THEN {'st': initial, 'c': best.c + CAST(cut AS BIGINT), 'a': best.a || 'K'} END
        ], lambda z: z IS NOT NULL)) AS u(m)
      ) y JOIN w w1 ON w1.st = y.st JOIN w w2 ON w2.st = w1.due
    ))
  ) GROUP BY conv_id, i, st
), told AS (
  SELECT f.conv_id, min(best) AS best FROM facts f JOIN dp ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND dp.i = f.n WHERE st IN ('n', 'a') GROUP BY f.conv_id
), replay AS (
  SELECT conv_id, best.a AS audit, 0::BIGINT AS k, 0::BIGINT AS i, 'n' AS st, [] ::VARCHAR[] AS lines FROM told
  UNION ALL
  SELECT p.conv_id, audit, k + 1, p.i + CAST(letter <> 'I' AS BIGINT), CASE letter WHEN 'D' THEN p.st WHEN 'K' THEN r.initial ELSE due END,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE due WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, substring(audit, CAST(k + 1 AS BIGINT), 1) AS letter FROM replay WHERE k < length(audit)) p JOIN w ON w.st = p.st LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN (SELECT * FROM replay WHERE k = length(audit)) p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_formatting, op2_sentencepiece, op3_url_filters, op4_language_id, op5_sharding, op6_mixing, op7_licence_scans, op8_fingerprints, op9_quality_rules, op10_near_duplicates, op11_exact_duplicates, op12_alignment, op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op5_sharding": _op5_sql(), "op6_mixing": OP6_SQL, "op7_licence_scans": _op7_sql(), "op11_exact_duplicates": OP11_SQL, "op13_conversation_repair": OP13_SQL}
