"""SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from .conversations import BLANK, FAILURE_WORDS, NOTICE_CHARS, ROLE_NAMES



def _trimmed(column: str) -> str:
    return f"regexp_replace(lower({column}), '^{BLANK}+|{BLANK}+$', '', 'g')"


_ROLES = " ".join(f"WHEN {_trimmed('role')} IN ({', '.join(repr(n) for n in names)}) THEN '{role}'" for role, names in ROLE_NAMES.items())
_FAILURE = "|".join(FAILURE_WORDS)
_NOTICE = (
    rf"length(said_text) <= {NOTICE_CHARS} AND (regexp_matches(said_text, '^[\[<(（【][^\[\]<>()（）【】]*(?:{_FAILURE})[^\[\]<>()（）【】]*[\]>)）】]$') "
    rf"OR regexp_matches(said_text, '^(?:[⚠❌✖!]️?{BLANK}*.*(?:{_FAILURE})|\**error\**{BLANK}*:)'))"
)
_THREADS = f"""
WITH named AS (
  SELECT conversation_id, message_id, content, turn_group, coalesce(version, -1) AS version, ingested_at, CASE {_ROLES} END AS speaker,
         {_trimmed("content")} AS said_text,
         CASE WHEN abs(created_at) < 100000000000 THEN created_at * 1000 ELSE created_at END AS at_ms
  FROM messages WHERE conversation_id IS NOT NULL),
once AS (
  SELECT *, coalesce(said_text <> '' AND NOT ({_NOTICE}), false) AS said FROM named
  QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC NULLS LAST, version DESC, conversation_id, at_ms NULLS FIRST, speaker NULLS FIRST) = 1),
worded AS (
  SELECT * FROM once
  QUALIFY coalesce(turn_group, '') = '' OR version = max(version) OVER (PARTITION BY conversation_id, turn_group)),
kept AS (
  SELECT *, row_number() OVER w - 1 AS position, CASE WHEN speaker IN ('user', 'assistant') THEN speaker END AS part FROM worded WHERE said
  WINDOW w AS (PARTITION BY conversation_id ORDER BY at_ms NULLS LAST, message_id)),
spoken AS (
  SELECT *, lead(part) OVER (PARTITION BY conversation_id ORDER BY position) AS reply FROM kept WHERE part IS NOT NULL),
heads AS (
  SELECT conversation_id, count(*) AS n, bool_or(speaker IS NULL) AS unreadable FROM kept GROUP BY conversation_id),
parts AS (
  SELECT conversation_id, min_by(part, position) AS opening, bool_or(part = 'user' AND coalesce(reply, '') <> 'assistant') AS unanswered FROM spoken GROUP BY conversation_id),
ids AS (
  SELECT conversation_id FROM conversations WHERE conversation_id IS NOT NULL
  UNION SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL),
verdicts AS (
  SELECT i.conversation_id,
         i.conversation_id NOT IN (SELECT conversation_id FROM conversations WHERE conversation_id IS NOT NULL) OR coalesce(h.n, 0) = 0 OR h.unreadable
         OR coalesce(p.opening, '') <> 'user' OR p.unanswered AS dropped
  FROM ids i LEFT JOIN heads h USING (conversation_id) LEFT JOIN parts p USING (conversation_id))
"""

_LETTERS = r"regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g')"

ORACLES = {
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE ceil(octet_length(encode(content)) / 4.0) > 512",
    "p3_found": f"""
        WITH texts AS (SELECT chunk_id, {_LETTERS} AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id, t),
        one AS (SELECT chunk_id, min_by(t, md5(t)) AS t FROM texts WHERE length(t) >= 200 GROUP BY chunk_id),
        names AS (SELECT t, min(chunk_id) AS rep FROM one GROUP BY t),
        runs AS (SELECT DISTINCT rep, substr(t, g.i::BIGINT, 5) AS run FROM names, LATERAL (SELECT unnest(generate_series(1, length(t) - 4)) AS i) g),
        sizes AS (SELECT rep, count(*) AS n FROM runs GROUP BY rep),
        both_have AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.rep < y.rep GROUP BY x.rep, y.rep),
        alike AS (
          SELECT a, b FROM both_have h JOIN sizes p ON p.rep = a JOIN sizes q ON q.rep = b WHERE h.n >= 0.65 * (p.n + q.n - h.n)
          UNION ALL SELECT rep, rep FROM names),
        members AS (SELECT chunk_id, rep FROM one JOIN names USING (t))
        SELECT DISTINCT least(x.chunk_id, y.chunk_id) AS chunk_id_a, greatest(x.chunk_id, y.chunk_id) AS chunk_id_b
        FROM alike JOIN members x ON x.rep = a JOIN members y ON y.rep = b WHERE x.chunk_id <> y.chunk_id""",
    "p4_found": _THREADS + "SELECT conversation_id FROM verdicts WHERE dropped",
    "p4_conversations": _THREADS + """
        SELECT conversation_id, position, message_id, speaker, at_ms, content FROM kept
        WHERE conversation_id IN (SELECT conversation_id FROM verdicts WHERE NOT dropped)""",
    "p5_found": " UNION ALL ".join(
        f"""
        SELECT '{name}' AS collection, id_a, id_b FROM (
          WITH usable AS (
            SELECT {key} AS id, CAST({vector} AS DOUBLE[]) AS v FROM {name}
            WHERE {key} IS NOT NULL AND len({vector}) = 64 AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({vector}, lambda x: x <> 0)) > 0),
          one AS (SELECT id, min(v) AS v FROM usable GROUP BY id),
          scored AS (
            SELECT x.id AS id, y.id AS other, round(list_cosine_similarity(x.v, y.v), 6) AS c FROM one x JOIN one y ON x.id <> y.id
            WHERE round(list_cosine_similarity(x.v, y.v), 6) >= 0.85
            QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY c DESC, y.id) <= 5)
          SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM scored)"""
        for name, key, vector in (("chunk_vectors", "chunk_id", "vector"), ("semantic_cache", "cache_id", "query_embedding"))
    ),
}
