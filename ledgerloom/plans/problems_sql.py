"""DuckDB SQL of the p1_... and p4_... queries, over whole tables."""

_CLAIMS = r"""
claims AS (
  SELECT episode_id, trim(regexp_replace(lower(slot), '[\s_\-\x{00a0}\x{3000}\x{200b}\x{feff}]+', ' ', 'g')) AS slot,
         turn, rank, record, value,
         regexp_replace(lower(value), '[^\p{L}\p{N}]', '', 'g') AS key
  FROM (
    SELECT episode_id, slot, valid_from_turn AS turn, 0 AS rank,
           coalesce(try_cast(regexp_extract(fact_id, '/[a-z]+([0-9]+)(@[^/#]*)?#', 1) AS BIGINT), -1) AS record,
           CASE WHEN coalesce(erased, false) THEN '' ELSE value END AS value, coalesce(erased, false) AS erased FROM fact_history
    UNION ALL
    SELECT episode_id, slot, observed_turn, 1, coalesce(seq, -1),
           CASE WHEN coalesce(erased, false) THEN '' ELSE value END, coalesce(erased, false) FROM fact_ledger)
  WHERE episode_id IS NOT NULL AND slot IS NOT NULL AND turn >= 0
    AND (erased OR regexp_replace(coalesce(value, ''), '[\s\x{00a0}\x{3000}\x{200b}\x{feff}]+', '', 'g') <> '')),
"""

_VERSIONS = (
    "WITH "
    + _CLAIMS
    + """
points AS (
  SELECT episode_id, slot, turn, value, key FROM claims
  QUALIFY row_number() OVER (PARTITION BY episode_id, slot, turn ORDER BY rank DESC, record DESC, key DESC, value DESC) = 1),
starts AS (
  SELECT * FROM points
  QUALIFY coalesce(lag(key) OVER (PARTITION BY episode_id, slot ORDER BY turn) <> key, true))
SELECT episode_id, slot, {value} turn AS valid_from_turn,
       coalesce(lead(turn) OVER (PARTITION BY episode_id, slot ORDER BY turn), -1) AS valid_to_turn
FROM starts
"""
)

_LINKS = r"""
arch AS (
  SELECT summary_id, superseded_by FROM archived_summaries WHERE summary_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY summary_id ORDER BY ts DESC NULLS LAST, superseded_by DESC NULLS LAST) = 1),
idx AS (
  SELECT index_id, child_index_ids FROM index_entries WHERE index_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC NULLS LAST, child_index_ids DESC NULLS LAST) = 1),
ids AS (
  SELECT 'summary' AS forest, summary_id AS id FROM (SELECT summary_id FROM arch UNION SELECT summary_id FROM active_summaries WHERE summary_id IS NOT NULL)
  UNION ALL SELECT 'index', index_id FROM idx),
parts AS (
  SELECT *, regexp_extract(id, '^(.*)/[^/]*$', 1) AS ep, regexp_extract(id, '([^/@]*)(?:@[^/]*)?$', 1) AS short, regexp_extract(id, '@([^/@]*)$', 1) AS hash FROM ids),
refs AS (
  SELECT forest, own, ref, regexp_extract(CASE WHEN contains(ref, '/') THEN ref ELSE own END, '^(.*)/[^/]*$', 1) AS ep,
         regexp_extract(ref, '([^/@]*)(?:@[^/]*)?$', 1) AS short, regexp_extract(ref, '@([^/@]*)$', 1) AS hash
  FROM (SELECT 'summary' AS forest, summary_id AS own, trim(superseded_by, e' \t\n\r 　') AS ref FROM arch
        UNION ALL SELECT 'index', index_id, trim(c, e' \t\n\r 　') FROM (SELECT index_id, unnest(child_index_ids) AS c FROM idx))
  WHERE ref <> ''),
found AS (
  SELECT r.forest, r.own, p.id AS target FROM refs r JOIN parts p ON r.forest = p.forest AND r.ep = p.ep AND r.short = p.short AND (r.hash = '' OR r.hash = p.hash)),
links AS (
  SELECT forest, own AS id, min(target) AS parent FROM found WHERE forest = 'summary' GROUP BY ALL
  UNION ALL SELECT forest, target, min(own) FROM found WHERE forest = 'index' GROUP BY ALL),
"""

SQL = {
    "p1_found": "WITH RECURSIVE "
    + _LINKS
    + """
walk AS (
  SELECT forest, id AS node, id AS spot, 0 AS d FROM ids
  UNION ALL
  SELECT w.forest, w.node, l.parent, w.d + 1 FROM walk w JOIN links l ON l.forest = w.forest AND l.id = w.spot WHERE w.d < 1000),
top AS (
  SELECT w.forest, w.node, w.spot, w.d FROM walk w LEFT JOIN links l ON l.forest = w.forest AND l.id = w.spot WHERE l.parent IS NULL),
stuck AS (
  SELECT forest, id FROM ids EXCEPT SELECT forest, node FROM top),
ring AS (
  SELECT w.forest, w.node, min(w.spot) AS least FROM walk w JOIN stuck s ON w.forest = s.forest AND w.node = s.id WHERE w.d >= 500 GROUP BY ALL)
SELECT forest, node AS node_id, spot AS root_id, d AS depth FROM top
UNION ALL SELECT forest, node, least, -1 FROM ring
""",
    "p4_found": _VERSIONS.replace("{value}", ""),
    "p4_history": _VERSIONS.replace("{value}", "value,"),
    "p4_ledger": "WITH "
    + _CLAIMS
    + """
one AS (SELECT episode_id, slot, turn, rank, record, key, min(value) AS value FROM claims GROUP BY ALL)
SELECT episode_id, slot, turn, rank, record, value,
       coalesce(CAST(lead(rank) OVER w AS VARCHAR), '') AS superseded_rank, coalesce(CAST(lead(record) OVER w AS VARCHAR), '') AS superseded_record
FROM one WINDOW w AS (PARTITION BY episode_id, slot, turn ORDER BY rank, record, key)
""",
}

SQL["p4_intervals"] = (
    "WITH "
    + _CLAIMS
    + """
one AS (SELECT episode_id, slot, turn, rank, record, max((key, value)) AS said FROM claims GROUP BY ALL),
points AS (SELECT episode_id, slot, turn, min((rank, record)) AS first FROM one GROUP BY ALL),
-- every claim of a slot is an event of each turn known by then; a row stands while its value and end do
events AS (
  SELECT p.episode_id, p.slot, p.turn, e.rank, e.record FROM points p JOIN one e ON p.episode_id = e.episode_id AND p.slot = e.slot AND (e.rank, e.record) >= p.first
  GROUP BY ALL),
state AS (
  SELECT v.episode_id, v.slot, v.turn, v.rank, v.record, max((o.rank, o.record, o.said)) FILTER (o.turn = v.turn) AS last,
         min(o.turn) FILTER (o.turn > v.turn) AS until
  FROM events v JOIN one o ON v.episode_id = o.episode_id AND v.slot = o.slot AND o.turn >= v.turn AND (o.rank, o.record) <= (v.rank, v.record) GROUP BY ALL),
changed AS (
  SELECT * FROM state
  WINDOW w AS (PARTITION BY episode_id, slot, turn ORDER BY rank, record)
  QUALIFY lag(rank) OVER w IS NULL OR (last[1], last[2]) = (rank, record) OR coalesce(until, -1) <> coalesce(lag(until) OVER w, -1))
SELECT episode_id, slot, last[3][2] AS value, turn AS valid_from_turn, coalesce(until, -1) AS valid_to_turn, rank, record,
       coalesce(CAST(lead(rank) OVER n AS VARCHAR), '') AS until_rank, coalesce(CAST(lead(record) OVER n AS VARCHAR), '') AS until_record
FROM changed WINDOW n AS (PARTITION BY episode_id, slot, turn ORDER BY rank, record)
"""
)

SQL["supersede_chain"] = (
    "WITH RECURSIVE "
    + _LINKS
    + """
walk AS (
  SELECT id AS summary_id, id AS spot, 0 AS steps FROM ids WHERE forest = 'summary'
  UNION ALL
  SELECT w.summary_id, l.parent, w.steps + 1 FROM walk w JOIN links l ON l.forest = 'summary' AND l.id = w.spot WHERE w.steps < 1000),
ends AS (SELECT DISTINCT w.summary_id FROM walk w LEFT JOIN links l ON l.forest = 'summary' AND l.id = w.spot WHERE l.parent IS NULL)
SELECT summary_id, spot AS successor, steps FROM walk SEMI JOIN ends USING (summary_id) WHERE steps > 0
"""
)
