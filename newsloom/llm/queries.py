"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import ann, chat, line_dedup, mixing, packing, quality, secrets, sharding, simhash, url_filter

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Suffixes of two labels that the url query knows; the operator takes a table of any length.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "co.za", "com.mx", "com.cn", "com.tr")
PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own; ``labels`` with the same number stand in for them."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    suffixes = spark.sql(f"SELECT * FROM VALUES {_SUFFIXES} AS t(suffix)")
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES, suffixes=suffixes)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("posterior", 9).alias("posterior"), F.round("lower", 9).alias("lower"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_versions(_table(spark, sf_dir, "documents"), secrets.empty_ledger(spark))
    return secrets.span_report(found)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), threshold=2, shingle=3)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0, 'user', '{PROBE}'), (-1L, 1, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)").to(rows.schema)
    return chat.format_report(chat.as_log(rows.unionByName(probe)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_ann, op2_urls, op3_secrets, op4_shards, op5_packing, op6_line_dedup, op7_quality, op8_simhash, op9_chat, op10_mixing)}

_WORD = r"'[^\x20\x09-\x0D]+'"

_SUFFIXES = ", ".join(f"('{x}')" for x in SUFFIXES)


def _shrink(units: str, parents: str, key: str, parent: str) -> str:
    """SQL of one level's shrinkage: ``units`` joined to ``parents`` (parent, prior)."""
    return f"""
      SELECT u.*, s.strength * p.prior + u.bad AS a, s.strength * (1 - p.prior) + u.n - u.bad AS b
      FROM {units} u JOIN {parents} p ON u.{parent} = p.{key}, (
        SELECT 1 / least(0.5, greatest(0.005, coalesce(CASE WHEN noise * (nn - n2 / nn - (c - 1)) > 0
          THEN ((k2 - nn * m * m) - noise * (c - 1)) / (noise * (nn - n2 / nn - (c - 1))) END, 0.005))) - 1 AS strength
        FROM (SELECT *, m * (1 - m) AS noise FROM (
          SELECT sum(bad)::DOUBLE / sum(n) AS m, count(*) AS c, sum(n)::DOUBLE AS nn, sum(n * n)::DOUBLE AS n2, sum(bad * bad::DOUBLE / n) AS k2
          FROM {units} WHERE n > 0))) s"""


def _rule_sql(column: int) -> str:
    """``column`` 0: the rule, 1: its verdict."""
    when = []
    for rule in sorted(URL_RULES, key=lambda r: -len(r[0])):
        on, _, below = rule[0].partition("/")
        when.append(f"WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '/{below}') THEN '{rule[column]}'")
    return "CASE " + " ".join(when) + " END"


SQL = {
    "op2_urls": rf"""
WITH known(suffix) AS (VALUES {_SUFFIXES}
), rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), per_page AS (
  SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::BIGINT) AS k
  FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1
), bare AS (
  SELECT host, regexp_replace(host, '\.?(:\d*)?$', '') AS bare, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS bad
  FROM parts LEFT JOIN per_page USING (page_id) GROUP BY 1, 2
), hosts AS (
  SELECT host, n, bad, CASE WHEN regexp_matches(bare, '^(\d+\.){{3}}\d+$') THEN bare ELSE array_to_string(list_slice(string_split(bare, '.'),
    -(CASE WHEN array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') IN (SELECT suffix FROM known) THEN 3 ELSE 2 END), -1), '.') END AS domain
  FROM bare
), domains AS (
  SELECT domain, CASE WHEN regexp_matches(domain, '^(\d+\.){{3}}\d+$') OR NOT contains(domain, '.') THEN '' ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix,
    sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1
), suffixes AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1
), whole AS (SELECT 0 AS k, (sum(bad) + 0.5) / (sum(n) + 1) AS prior FROM suffixes
), s AS (SELECT suffix AS k, a / (a + b) AS prior FROM ({_shrink("suffixes", "whole", "k", "one")})
), d AS (SELECT domain AS k, a / (a + b) AS prior FROM ({_shrink("domains", "s", "k", "suffix")})
), h AS (SELECT host, round(a / (a + b), 9) AS posterior, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ({_shrink("hosts", "d", "k", "domain")})
)
SELECT page_id, host, path, {_rule_sql(0)} AS rule, coalesce({_rule_sql(1)}, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, posterior, round(bound, 9) AS lower
FROM parts LEFT JOIN h USING (host)""",
    "op6_line_dedup": r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), lines AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM every
), windows AS (
  SELECT doc_id, i, lead(i, 1) OVER w AS j, lead(i, 2) OVER w AS k, x || chr(10) || lead(x, 1) OVER w || chr(10) || lead(x, 2) OVER w AS said
  FROM lines WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS r FROM windows WHERE said IS NOT NULL
), covered AS (SELECT DISTINCT doc_id, unnest([i, j, k]) AS i FROM ranked WHERE r > 1
), kept AS (
  SELECT e.doc_id, coalesce(string_agg(line, chr(10) ORDER BY e.i) FILTER (c.i IS NULL), '') AS text, count(c.i) AS lines_removed
  FROM every e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1
)
SELECT doc_id, k.text, coalesce(lines_removed, 0) AS lines_removed FROM documents LEFT JOIN kept k USING (doc_id)""",
    "op7_quality": rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {_WORD})) AS word, unnest(range(len(regexp_extract_all(text, {_WORD})))) AS i FROM documents
), tri AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w1, w2) AS c FROM tri WHERE w2 IS NOT NULL
), rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY 1
), counted AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY 1
), lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), norm AS (
  SELECT doc_id, source, lower(array_to_string(regexp_extract_all(line, {_WORD}), ' ')) AS said, len(regexp_extract_all(line, {_WORD})) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), sets AS (SELECT doc_id, source, list_sort(list_distinct(list(said))) AS said FROM norm GROUP BY 1, 2
), hosts AS (SELECT d.source, count(DISTINCT coalesce(said, [])) AS of_host FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id GROUP BY 1
), different AS (SELECT DISTINCT source, said FROM sets
), frequent AS (
  SELECT source, line AS said FROM (SELECT source, unnest(said) AS line FROM different) JOIN hosts USING (source) GROUP BY source, line, of_host
  HAVING count(*) > 20 AND count(*) > 0.05 * of_host
), gone AS (SELECT doc_id, sum(n) AS removed_words FROM norm JOIN frequent USING (source, said) GROUP BY 1
), base AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept FROM base""",
    "op9_chat": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS safe,
    replace(replace(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n') AS safe_role FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN)} + length(safe_role) + 1 + length(safe) + {len(chat.END) + 1})::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op10_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS ident FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1
), ranked AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 3.0::DOUBLE AS most,
    row_number() OVER (ORDER BY source NULLS LAST) AS r FROM per
), filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(most, coalesce(w * max(level) FILTER (most / w > level) OVER (), most)) AS target FROM filled
), rates AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
), drawn AS (
  SELECT doc_id, s.source, size, source_size, target, whole, seed, (('0x' || substr(md5(seed || ':' || ident), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < fraction)::BIGINT AS extra
  FROM sized s JOIN rates t ON s.source IS NOT DISTINCT FROM t.source, range(16) AS g(seed)
), chosen AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed
  FROM (SELECT source, seed, abs(sum(size * extra) - (any_value(target) - any_value(whole) * any_value(source_size))) AS off FROM drawn GROUP BY 1, 2) GROUP BY 1
)
SELECT doc_id, size, source_size, target, size * (whole + extra) AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed""",
}
