"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import VOCABULARY, encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, windows

    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT -1L AS conv_id, stack(2, 0L, 'user', '{said}', 1L, 'assistant', '{said}') AS (turn, role, text)")
    return digests(windows(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_dedup import embedding_duplicates

    return embedding_duplicates(read(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import source_divergence

    return source_divergence(read(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .structure_repair import structure_repair

    return structure_repair(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language_id, op3_decontamination, op4_toxicity, op5_lm_scoring, op6_quality_classifier, op7_quality_rules, op8_chat_format, op9_pii, op10_simhash, op11_embedding_dedup, op12_source_divergence, op13_structure_repair)}
ORACLES: dict[str, str] = {
    # every two vectors of a label; the shortest path of ids takes as many steps as a component is wide
    "op11_embedding_dedup": r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT *, list_sum(list_transform(v, lambda x: x * x)) AS q FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (sqrt(a.q) * sqrt(b.q)) >= 0.98),
reach AS (SELECT r, r AS o FROM e UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.o),
root AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.o GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN root USING (r) LEFT JOIN n USING (r)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN found USING (lang, source) GROUP BY lang, source),
own AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM total JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM found JOIN size USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    # backward costs alone, and the least letter that keeps to them
    "op13_structure_repair": r"""
WITH RECURSIVE c AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM conversations),
d AS (SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, (VALUES (1), (2)) AS copy(k) WHERE fault <> 0 AND (k = 1 OR fault = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS a, lead(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS b FROM n),
r AS (SELECT c, i, role, text, a, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS extra FROM f),
told AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (b IS NOT NULL AND a || b NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY c),
back AS (SELECT c, n + 1 AS i, 0 AS b0, 4 AS b1, 2 AS b2, 0 AS b3 FROM told
  UNION ALL SELECT c, i, least(w0, 2 + least(w2, 2 + w3)), least(w1, 2 + least(w2, 2 + w3)), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
    SELECT r.c, r.i,
      CASE WHEN gone THEN b0 + 3 ELSE least(b0 + 3, b2 + 2 + extra, CASE a WHEN 's' THEN b1 + extra WHEN 'u' THEN b2 + extra ELSE 1000000000 END) END AS w0,
      CASE WHEN gone THEN b1 + 3 ELSE least(b1 + 3, b2 + 2 + extra, CASE a WHEN 'u' THEN b2 + extra ELSE 1000000000 END) END AS w1,
      CASE WHEN gone THEN b2 + 3 ELSE least(b2 + 3, b3 + 2 + extra, CASE a WHEN 'a' THEN b3 + extra ELSE 1000000000 END) END AS w2,
      CASE WHEN gone THEN b3 + 3 ELSE least(b3 + 3, b2 + 2 + extra, CASE a WHEN 'u' THEN b2 + extra ELSE 1000000000 END) END AS w3
    FROM back JOIN r ON r.c = back.c AND r.i = back.i - 1)),
cost AS (SELECT c, i, unnest([0, 1, 2, 3]) AS s, unnest([b0, b1, b2, b3]) AS b FROM back),
walk AS (SELECT c, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said, false AS done FROM told
  UNION ALL SELECT c, CASE WHEN letter IN ('I', 'E') THEN i ELSE i + 1 END, CASE WHEN letter IN ('I', 'R') THEN t WHEN letter = 'K' THEN k ELSE s END, audit || CASE letter WHEN 'E' THEN '' ELSE letter END,
    CASE letter WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, who || ':' || text) WHEN 'I' THEN list_append(said, who || ':') ELSE said END, letter = 'E' FROM (
    SELECT w.*, role, text, CASE WHEN w.s = 2 THEN 3 ELSE 2 END AS t, CASE WHEN w.s = 2 THEN 'assistant' ELSE 'user' END AS who, CASE a WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END AS k,
      CASE WHEN r.i IS NULL THEN CASE WHEN here.b = 0 THEN 'E' ELSE 'I' END
        WHEN here.b = 3 + d.b THEN 'D' WHEN here.b = 2 + ins.b THEN 'I'
        WHEN NOT gone AND here.b = extra + keep.b THEN 'K' ELSE 'R' END AS letter
    FROM walk w LEFT JOIN r ON r.c = w.c AND r.i = w.i
    JOIN cost here ON here.c = w.c AND here.i = w.i AND here.s = w.s
    LEFT JOIN cost d ON d.c = w.c AND d.i = w.i + 1 AND d.s = w.s
    LEFT JOIN cost ins ON ins.c = w.c AND ins.i = w.i AND ins.s = CASE WHEN w.s = 2 THEN 3 ELSE 2 END
    LEFT JOIN cost keep ON keep.c = w.c AND keep.i = w.i + 1 AND keep.s = CASE WHEN a = 's' AND w.s = 0 THEN 1 WHEN a = 'u' AND w.s <> 2 THEN 2 WHEN a = 'a' AND w.s = 2 THEN 3 END
    WHERE NOT done))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM c) LEFT JOIN told USING (c) LEFT JOIN (SELECT c, b0 FROM back WHERE i = 1) USING (c) LEFT JOIN (SELECT c, audit, said FROM walk WHERE done) USING (c)""",
    "op7_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
tok AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d)),
gram AS (SELECT rid, p, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x || ' ' || lead(w, 3) OVER x || ' ' || lead(w, 4) OVER x AS g FROM tok WINDOW x AS (PARTITION BY rid ORDER BY p)),
again AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM gram WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2, p + 3, p + 4]) AS q FROM again) GROUP BY rid),
line AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
size AS (SELECT rid, count(*) AS n FROM tok GROUP BY rid),
f AS (SELECT doc_id, source, coalesce(size.n, 0) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN size USING (rid) LEFT JOIN line USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
r AS (SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR n_dup_lines > 3 OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k FROM r WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT least(greatest(coalesce(sum(k) / sum(n), 0.5), 0.001), 0.999) AS mean, coalesce(var_pop(k / n), 0.0) AS v FROM h),
s AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v, 0.000001) - 1, 1.0), 10000.0) AS strength FROM m),
p AS (SELECT source, n + strength AS size, (k + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate - 2.0 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5, false) AS kept
FROM r LEFT JOIN p USING (source)""",
    "op8_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
t AS (SELECT *, n = 1 AND role = 'system' AS system, CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE len(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+')) + 4 END AS tokens,
  length('<|turn|>' || regexp_replace(role, '([<\[])(~*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2~\3', 'g') || '<|text|>' || regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2~\3', 'g') || '<|end|>') AS size FROM n),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) AS till FROM t),
b AS (SELECT *, till - tokens AS since, dense_rank() OVER (PARTITION BY conv_id ORDER BY floor(greatest(till - 1, 0) / 768)) AS win FROM u),
f AS (SELECT conv_id, win, min(since) AS first FROM b GROUP BY conv_id, win),
shown AS (SELECT b.conv_id, b.size FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND (b.system OR f.win = b.win OR (f.win BETWEEN b.win + 1 AND b.win + 3 AND f.first - b.since <= 256))),
chars AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said, coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss FROM n GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN chars ON chars.conv_id IS NOT DISTINCT FROM d.conv_id""",
}
