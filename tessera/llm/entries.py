"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chat_format, decontaminate, divergence, embedding_join, language_id, license_scan, line_dedup, lm_score, packing, pii, simhash, spelling,
    url_filter,
)
from tessera.llm.shared import table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify(docs.select("doc_id", "text"), language_id.train_on_documents(docs))
    return named.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(chat_format.ADDED, chat_format.ROW)
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(added)))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"), slip=199)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_neardup": op1_embedding_neardup,
        "op2_license_scan": op2_license_scan,
        "op3_pii": op3_pii,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_chat_format": op6_chat_format,
        "op7_lm_score": op7_lm_score,
        "op8_decontaminate": op8_decontaminate,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "op11_source_divergence": op11_source_divergence,
        "op12_url_filter": op12_url_filter,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


_EMBEDDING_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS found FROM embeddings
  UNION
  SELECT l.a, r.found FROM reach r JOIN links l ON l.b = r.node
), least AS (SELECT node, min(found) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN counted ON a = vec_id
"""

_LINES_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM parts
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.TURN + chat_format.BODY + chat_format.END)}
    + length(regexp_replace(role, '{chat_format.CONTROL}', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '{chat_format.CONTROL}', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text, row_number() OVER () AS doc FROM documents
), words AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counted x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM grid WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
"""


def _url_sql() -> str:
    """Every term of the vocabulary looked for by a pattern of its own."""
    letter, digit = r"[\x00-\x60\x7B-\x7F]", "[^0-9]"
    edge = lambda c: digit if c.isdigit() else letter
    terms = sorted((t, strict, points, f"(?:^|{edge(t[0])}){t}(?:{edge(t[-1])}|$)") for t, (strict, points) in url_filter.vocabulary().items())
    listed = ", ".join(f"('{t}', {strict}, {points}, '{pattern}')" for t, strict, points, pattern in terms)
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
    return rf"""
WITH terms(term, strict, points, pattern) AS (VALUES {listed}), rules(h, p, decision) AS (VALUES {rules}),
urls AS (
  SELECT page_id, row_number() OVER () AS page, {_LOWER.format("coalesce(url, '')")} AS lowered,
    {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT page, arg_max(h || p, length(h || p)) AS rule, arg_max(decision, length(h || p)) AS decision
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page
), hits AS (
  SELECT page, string_agg(term, ',' ORDER BY term) FILTER (WHERE strict) AS strict, string_agg(term, ',' ORDER BY term) FILTER (WHERE NOT strict) AS soft,
    sum(points) AS points, count_if(NOT strict) AS several
  FROM urls JOIN terms ON regexp_matches(lowered, pattern) GROUP BY page
)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN strict IS NOT NULL OR several > 1 AND points >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict, '') AS strict, coalesce(soft, '') AS soft, coalesce(points, 0)::BIGINT AS points
FROM urls LEFT JOIN ruled USING (page) LEFT JOIN hits USING (page)
"""


_SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END
    FOR x IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]) AS b FROM counted
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda h, x:
    list_reduce(list_prepend(xor(h, x), list_value(0::UBIGINT, 0, 0, 0, 0, 0, 0, 0)), lambda a, z: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))), 4294967295::UBIGINT)::BIGINT AS h
  FROM bytes
), typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), holes AS (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), named AS (
  SELECT word, min(other) AS other FROM near JOIN best USING (word) WHERE other_n = most GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word) LEFT JOIN named USING (word)
), ways AS (
  SELECT word, word AS last FROM judged UNION ALL SELECT w.word, j.form FROM ways w JOIN judged j ON j.word = w.last WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, w.last AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN ways w ON w.word = j.word JOIN judged e ON e.word = w.last WHERE e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op1_embedding_neardup": _EMBEDDING_SQL, "op5_line_dedup": _LINES_SQL, "op6_chat_format": _CHAT_SQL,
        "op11_source_divergence": _DIVERGENCE_SQL, "op12_url_filter": _url_sql(), "op13_spelling_variants": _SPELLING_SQL,
    }
