"""SQL counterparts of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from corpuskit.plans import sqltext as S

_HASH = "'0' || substr(sha256(concat_ws(':', CAST(coalesce(seed, 0) AS VARCHAR), source, example_id)), 1, 13)"
_THRESHOLD = "lpad(lower(to_hex(CAST(floor(least(greatest(coalesce(sample_share, 0.0), 0.0), 1.0) * 4503599627370496.0) AS BIGINT))), 14, '0')"
_DRAWN = f"""
  SELECT example_id, source, {_HASH} AS key_hash, min(batch_no) AS batch_no, {_THRESHOLD} AS threshold, sample_share
  FROM chat_examples JOIN dataset_manifest USING (source)
  WHERE example_id IS NOT NULL
  GROUP BY ALL
"""

_TEXT = "regexp_replace(json_extract_string(raw_json, '$.' || coalesce(text_field, 'text')), '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g')"


def _read(x: str) -> str:
    """How a JSON leaf reads, by its type."""
    j = f"json_extract(raw_json, '{x}')"
    return f"CASE json_type({j}) WHEN 'VARCHAR' THEN 's' || {S.normal(f'nfc_normalize({j} ->> ' + chr(39) + '$' + chr(39) + ')')} WHEN 'NULL' THEN '' ELSE coalesce('n' || CAST({j} AS VARCHAR), '') END"


_CLASSES = f"""
valid AS MATERIALIZED (SELECT record_id, raw_json, coalesce(text_field, 'text') AS f FROM (SELECT DISTINCT record_id, source, raw_json FROM raw_records) LEFT JOIN dataset_manifest USING (source)
  WHERE json_valid(raw_json) AND json_type(CASE WHEN json_valid(raw_json) THEN raw_json END) = 'OBJECT'),
usable AS (SELECT record_id, raw_json, nfc_normalize(json_extract_string(raw_json, '$.' || f)) AS t FROM valid WHERE json_type(raw_json, '$.' || f) = 'VARCHAR' AND {S.strip("json_extract_string(raw_json, '$.' || f)")} <> ''),
keyed AS (SELECT record_id, sha256(concat_ws(chr(31), {S.normal("t")}, {_read("$.title")}, {_read("$.author")}, CASE WHEN json_type(raw_json, '$.attrs') = 'OBJECT' THEN array_to_string(list_sort(json_keys(raw_json, '$.attrs')), ',') ELSE '-' END, {_read("$.attrs.level")}, {_read("$.attrs.topic")}, {_read("$.attrs.stage")})) AS k FROM usable),
c AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS kept_id FROM keyed)
"""
_ALNUM = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"

SQL = {
    "p5_found": f"WITH {_CLASSES} SELECT kept_id, record_id AS copy_id FROM c WHERE record_id <> kept_id",
    "p5_records": f"WITH {_CLASSES} SELECT kept_id, count(*) AS copies FROM c GROUP BY kept_id",
    "p6_found": f"""
WITH i AS (SELECT item_id, w, least(8, len(w)) AS k FROM (SELECT item_id, {_ALNUM.format(x=S.folded("nfc_normalize(text)"))} AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, {_RUNS} AS gram FROM i),
d AS (SELECT doc_id, w, k FROM (SELECT doc_id, {_ALNUM.format(x=S.folded("nfc_normalize(text)"))} AS w FROM documents WHERE text IS NOT NULL) JOIN (SELECT DISTINCT k FROM i) ON len(w) >= k)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, k, {_RUNS} AS gram FROM d) JOIN g USING (k, gram)
""",
    # Bytes by 4.2 stand for tokens: no case is close enough for the tokenizer to matter.
    "p7_found": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(strlen(coalesce(text, ''))) / 4.2 AS tokens FROM (SELECT DISTINCT ON (doc_id) * FROM documents) WHERE source IS NOT NULL GROUP BY 1)
SELECT mixture, lower(trim(t.source)) AS source FROM mixture_targets t LEFT JOIN s ON s.source = lower(trim(t.source)) WHERE coalesce(s.tokens, 0) * max_repeats < total_tokens * target_share
""",
    "p1_found": f"""
WITH valid AS MATERIALIZED (
  SELECT record_id, raw_json, coalesce(text_field, 'text') AS text_field, coalesce(chunk_chars, 1000) AS chunk_chars
  FROM raw_records LEFT JOIN dataset_manifest USING (source)
  WHERE json_valid(raw_json) AND json_type(CASE WHEN json_valid(raw_json) THEN raw_json END) = 'OBJECT'
)
SELECT DISTINCT record_id FROM valid
WHERE json_type(raw_json, '$.' || text_field) = 'VARCHAR' AND length({_TEXT}) > chunk_chars
""",
    "p2_sample": f"SELECT example_id, source, key_hash, batch_no FROM ({_DRAWN}) WHERE key_hash < threshold",
    "p2_rates": f"""
SELECT source, count(*) AS n_examples, CAST(sum(CASE WHEN key_hash < threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_selected, sample_share,
       round(sum(CASE WHEN key_hash < threshold THEN 1 ELSE 0 END) / count(*), 9) AS actual_share
FROM ({_DRAWN}) GROUP BY source, sample_share
""",
    "p2_growth": f"""
WITH drawn AS (SELECT batch_no, count(*) AS added FROM ({_DRAWN}) WHERE key_hash < threshold GROUP BY batch_no)
SELECT batch_no, added, CAST(sum(added) OVER (ORDER BY batch_no) AS BIGINT) AS selected FROM drawn
""",
    "p3_found": """
WITH RECURSIVE fmt AS (
  SELECT source, coalesce(group_chunks, 8) AS per,
         CASE WHEN coalesce(trim(shard_format), '') <> '' THEN lower(trim(shard_format)) = 'jsonl'
              ELSE regexp_matches(shards[1], '(?i)\\.(jsonl|ndjson|json)(\\.gz)?$') END AS jsonl
  FROM dataset_manifest
), keyed AS (
  SELECT DISTINCT chunk_no, k FROM (
    SELECT chunk_no, unnest(list_concat(
      [concat_ws('|', 'g', source, shard_sha256, doc_index, CASE WHEN jsonl THEN 0 ELSE chunk_index // per END)],
      ['a|' || array_to_string(list_sort(regexp_extract_all(lower(author), '[\\p{L}\\p{N}]+')), ' ')],
      list_transform(coalesce(entity_ids, []), lambda e: 'e|' || lower(trim(e))))) AS k
    FROM corpus_chunks JOIN fmt USING (source))
  WHERE k NOT IN ('a|', 'a|unknown', 'a|anonymous', 'a|anon', 'a|none', 'a|a n', 'a|author no', 'e|')
), label(chunk_no, family_no) USING KEY (chunk_no) AS (
  SELECT chunk_no, chunk_no FROM (SELECT DISTINCT chunk_no FROM keyed)
  UNION
  SELECT m.chunk_no, min(o.least) FROM keyed m
  JOIN (SELECT k, min(l.family_no) AS least FROM keyed JOIN recurring.label l USING (chunk_no) GROUP BY k) o USING (k)
  JOIN recurring.label c ON c.chunk_no = m.chunk_no
  GROUP BY m.chunk_no, c.family_no HAVING min(o.least) < c.family_no
)
SELECT family_no, chunk_no FROM label WHERE family_no <> chunk_no
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
