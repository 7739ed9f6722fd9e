"""DuckDB SQL of the ledger queries, over whole tables.

Rules of texts are written here in their own words, not taken from ``functions.text``, but for the patterns of statements.
"""

from __future__ import annotations

from ..functions import text as T

_SP, _ED, _CJK = T.SPACES, T.EDGES, T.CJK
_WIDE, _PLAIN = T.width_maps()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_ED}]+|[{_ED}]+$', '', 'g')"


def _slot(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[{_ED}_\-]+', ' ', 'g'))"


def _key(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _tokens(c: str) -> str:
    rest = f"regexp_replace({c}, '[{_CJK}]', '', 'g')"
    signs = rf"regexp_replace({rest}, '[\p{{L}}\p{{N}}{_SP}]', '', 'g')"
    ascii_signs = rf"length(regexp_replace({signs}, '[^\x00-\x7F]', '', 'g'))"
    latin = rf"length(regexp_replace({rest}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    words = f"len(regexp_extract_all({c}, '[^{_SP}]+'))"
    total = f"(length({c}) - length({rest}))::DOUBLE * 1.0::DOUBLE + {latin}::DOUBLE * 0.30::DOUBLE + {words}::DOUBLE * 0.75::DOUBLE + {ascii_signs}::DOUBLE * 0.5::DOUBLE + (length({signs}) - {ascii_signs})::DOUBLE * 0.5::DOUBLE"
    return f"CASE WHEN length({c}) > 0 THEN greatest(1, CAST(round_even({total}, 0) AS INTEGER)) ELSE 0 END"


_NEWEST = "ORDER BY coalesce(ts, -1e308) DESC"
_CTES = {
    "raw": f"""SELECT reference_id, {_strip('episode_id')} AS episode_id, CASE WHEN turn_index >= 0 THEN turn_index END AS turn_index, user_msg, agent_msg, ts
      FROM raw_records WHERE reference_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY reference_id {_NEWEST}) = 1""",
    "archive": f"SELECT * FROM archived_summaries WHERE summary_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY summary_id {_NEWEST}) = 1",
    "active": f"""SELECT * FROM active_summaries WHERE summary_id IS NOT NULL AND summary_id NOT IN (SELECT summary_id FROM archive)
      QUALIFY row_number() OVER (PARTITION BY summary_id {_NEWEST}) = 1""",
    "entries": f"SELECT * FROM index_entries WHERE index_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id {_NEWEST}) = 1",
    "led": f"""SELECT fact_id, episode_id, summary_id, {_slot('slot')} AS slot, value, coalesce(seq, -1) AS seq, CASE WHEN observed_turn >= 0 THEN observed_turn END AS observed_turn,
      coalesce(evidence, []) AS evidence, coalesce(reason, '') AS reason, coalesce(residual_mentions, 0) AS residual_mentions, coalesce(erased, false) AS erased
      FROM fact_ledger WHERE fact_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY coalesce(seq, -1), observed_turn NULLS FIRST, value NULLS FIRST) = 1""",
    "probes": """SELECT * FROM probe_predictions WHERE run_id IS NOT NULL AND system IS NOT NULL AND episode_id IS NOT NULL AND probe_index IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY run_id, system, episode_id, probe_index) = 1""",
    "summaries": """SELECT summary_id, episode_id, seq, text, fact_keys, true AS live FROM active
      UNION ALL SELECT summary_id, episode_id, seq, text, fact_keys, false FROM archive""",
    "placed": """SELECT * FROM led WHERE observed_turn IS NOT NULL AND slot IS NOT NULL AND episode_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY episode_id, slot, observed_turn, seq ORDER BY fact_id DESC) = 1""",
    "cur": """SELECT episode_id, slot, value, fact_id, observed_turn FROM led WHERE NOT erased AND observed_turn IS NOT NULL AND slot IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY episode_id, slot ORDER BY observed_turn DESC, seq DESC, fact_id DESC) = 1""",
    "filed": "SELECT DISTINCT unnest(members) AS summary_id FROM entries",
    "unfiled": "SELECT * FROM active a WHERE NOT EXISTS (SELECT 1 FROM filed f WHERE f.summary_id = a.summary_id)",
    "shown": """SELECT episode_id, text FROM unfiled WHERE text IS NOT NULL UNION SELECT episode_id, title FROM entries WHERE title IS NOT NULL
      UNION SELECT episode_id, k FROM (SELECT episode_id, unnest(fact_keys) AS k FROM active) WHERE k IS NOT NULL""",
    "pairs": f"""SELECT summary_id, episode_id, seq, live, trim(split_part(k, '=', 1)) AS slot, trim(substr(k, instr(k, '=') + 1)) AS value
      FROM (SELECT summary_id, episode_id, seq, live, unnest(fact_keys) AS k FROM summaries)
      WHERE instr(k, '=') > 0 AND trim(split_part(k, '=', 1)) <> '' AND trim(substr(k, instr(k, '=') + 1)) <> ''""",
    "cost": f"""SELECT episode_id, turn_index AS turn, CAST(max({_tokens("coalesce(user_msg, '')")} + {_tokens("coalesce(agent_msg, '')")}) AS BIGINT) AS cost
      FROM raw WHERE turn_index IS NOT NULL GROUP BY ALL""",
    "gold": f"""SELECT DISTINCT episode_id, {_slot('fact_key')} AS slot, gold AS value, {_key('gold')} AS key FROM probes
      WHERE fact_key IS NOT NULL AND length({_key('gold')}) >= 2 AND probe_type <> 'no_history'""",
    "lost": "SELECT episode_id, fact_id, summary_id FROM led l WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.summary_id = l.summary_id)",
    "unreach": """SELECT episode_id, slot, value, fact_id FROM cur c WHERE coalesce(value, '') <> ''
      AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.episode_id = c.episode_id AND contains(s.text, c.value))""",
    "unres": """SELECT episode_id, fact_id, count(*) AS missing FROM (SELECT episode_id, fact_id, unnest(evidence) AS r FROM led WHERE NOT erased) e
      WHERE NOT EXISTS (SELECT 1 FROM raw WHERE raw.reference_id = e.r) GROUP BY ALL
      UNION ALL SELECT episode_id, fact_id, 0 FROM led WHERE NOT erased AND len(evidence) = 0""",
    "undone": """SELECT episode_id, fact_id, 'value_kept' AS problem FROM led WHERE erased AND coalesce(value, '') <> ''
      UNION ALL SELECT DISTINCT episode_id, fact_id, 'evidence_resolves' FROM (SELECT episode_id, fact_id, unnest(evidence) AS r FROM led WHERE erased) e
      WHERE r NOT IN (SELECT unnest(evidence) FROM led WHERE NOT erased) AND EXISTS (SELECT 1 FROM raw WHERE raw.reference_id = e.r)""",
    "report": """SELECT b.*, coalesce(l.n, 0) AS missing, coalesce(u.n, 0) AS unreachable, coalesce(v.a, 0) AS unresolved, coalesce(v.b, 0) AS without_evidence,
      coalesce(d.a, 0) AS value_kept, coalesce(d.b, 0) AS evidence_resolves
      FROM (SELECT episode_id, count(*) AS facts, count_if(erased) AS erased_facts, CAST(sum(CASE WHEN erased THEN residual_mentions ELSE 0 END) AS BIGINT) AS residual_mentions FROM led GROUP BY ALL) b
      LEFT JOIN (SELECT episode_id, count(*) AS n FROM lost GROUP BY ALL) l USING (episode_id)
      LEFT JOIN (SELECT episode_id, count(*) AS n FROM unreach GROUP BY ALL) u USING (episode_id)
      LEFT JOIN (SELECT episode_id, count_if(missing > 0) AS a, count_if(missing = 0) AS b FROM unres GROUP BY ALL) v USING (episode_id)
      LEFT JOIN (SELECT episode_id, count_if(problem = 'value_kept') AS a, count_if(problem = 'evidence_resolves') AS b FROM undone GROUP BY ALL) d USING (episode_id)""",
}
_NEEDS = {
    "active": ["archive"],
    "summaries": ["archive", "active"],
    "placed": ["led"],
    "cur": ["led"],
    "filed": ["entries"],
    "unfiled": ["archive", "active", "entries", "filed"],
    "shown": ["archive", "active", "entries", "filed", "unfiled"],
    "pairs": ["archive", "active", "summaries"],
    "cost": ["raw"],
    "gold": ["probes"],
    "lost": ["archive", "active", "summaries", "led"],
    "unreach": ["led", "cur", "archive", "active", "entries", "filed", "unfiled", "shown"],
    "unres": ["led", "raw"],
    "undone": ["led", "raw"],
    "report": ["led", "raw", "archive", "active", "summaries", "entries", "filed", "unfiled", "shown", "cur", "lost", "unreach", "unres", "undone"],
}


def _sql(needs: str, body: str, more: str = "") -> str:
    names: list[str] = []
    for n in needs.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in names:
                names.append(x)
    ctes = [f"{n} AS ({_CTES[n]})" for n in names] + ([more] if more else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body


_PROJECTION = """SELECT episode_id, slot, value, fact_id, observed_turn AS valid_from_turn,
  coalesce(lead(observed_turn) OVER w, -1) AS valid_to_turn, coalesce(lead(fact_id) OVER w, '') AS superseded_by, reason, erased
  FROM placed {where} WINDOW w AS (PARTITION BY episode_id, slot ORDER BY observed_turn, seq)"""
_EP = "regexp_extract({}, '(?s)^(.*)/[^/]*$', 1)"
_SHORT = "split_part(split_part({}, '/', -1), '@', 1)"

SQL = {
    "ledger_append_dedupe": _sql("led", "SELECT fact_id, episode_id, summary_id, slot, seq, coalesce(observed_turn, -1) AS observed_turn, erased FROM led"),
    "current_by_slot": _sql("cur", "SELECT * FROM cur"),
    "scd2_projection": _sql("placed", _PROJECTION.format(where="")),
    "history_asof": _sql("placed", _PROJECTION.format(where="WHERE observed_turn <= 10")),
    "temporal_anomalies": f"""WITH r AS (SELECT DISTINCT episode_id, {_slot('slot')} AS slot, valid_from_turn, valid_to_turn, value, fact_id, coalesce(erased, false) AS erased
      FROM fact_history WHERE valid_from_turn >= 0 AND slot IS NOT NULL AND episode_id IS NOT NULL),
    p AS (SELECT episode_id, slot, valid_from_turn AS f, valid_to_turn AS t FROM r
      QUALIFY row_number() OVER (PARTITION BY episode_id, slot, valid_from_turn ORDER BY fact_id DESC, valid_to_turn DESC NULLS LAST) = 1),
    n AS (SELECT *, lead(f) OVER (PARTITION BY episode_id, slot ORDER BY f) AS nx FROM p),
    k AS (SELECT episode_id, slot, 'ends_before_start' AS kind FROM n WHERE t < f
      UNION ALL SELECT episode_id, slot, 'open_before_another' FROM n WHERE t IS NULL AND nx IS NOT NULL
      UNION ALL SELECT episode_id, slot, 'overlap' FROM n WHERE t > nx
      UNION ALL SELECT episode_id, slot, 'gap' FROM n WHERE t < nx AND t >= f
      UNION ALL SELECT episode_id, slot, 'several_open' FROM r GROUP BY ALL HAVING count_if(valid_to_turn IS NULL) > 1
      UNION ALL SELECT episode_id, slot, 'none_open' FROM r GROUP BY ALL HAVING count_if(valid_to_turn IS NULL) = 0
      UNION ALL SELECT episode_id, slot, 'erased_with_value' FROM r GROUP BY ALL HAVING count_if(erased AND coalesce(value, '') <> '') > 0)
    SELECT episode_id, slot, kind, count(*) AS n FROM k GROUP BY ALL""",
    "registry_topn": _sql(
        "pairs",
        """SELECT episode_id, slot, value, summary_id, seq FROM last QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC, slot) <= 12""",
        "last AS (SELECT episode_id, lower(slot) AS slot, value, summary_id, seq FROM pairs WHERE live QUALIFY row_number() OVER (PARTITION BY episode_id, lower(slot) ORDER BY seq DESC, summary_id DESC, value DESC) = 1)",
    ),
    "registry_rendered": _sql(
        "pairs",
        """SELECT episode_id, string_agg(slot || '=' || value, '; ' ORDER BY seq, slot) AS registry FROM (SELECT * FROM last
        QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC, slot) <= 12) GROUP BY ALL""",
        "last AS (SELECT episode_id, lower(slot) AS slot, value, summary_id, seq FROM pairs WHERE live QUALIFY row_number() OVER (PARTITION BY episode_id, lower(slot) ORDER BY seq DESC, summary_id DESC, value DESC) = 1)",
    ),
    "ledger_stats": _sql("led", "SELECT episode_id, count(*) AS facts, count(DISTINCT slot) AS slots, count_if(reason <> '') AS left_facts FROM led GROUP BY ALL"),
    "reason_counts": _sql("led", "SELECT episode_id, reason, count(*) AS n FROM led WHERE reason <> '' GROUP BY ALL"),
    "reason_by_summary": _sql("led", "SELECT summary_id, reason FROM led WHERE reason <> '' QUALIFY row_number() OVER (PARTITION BY summary_id ORDER BY seq, fact_id) = 1"),
    "tombstones": _sql("led", "SELECT episode_id, fact_id, CASE WHEN erased OR reason = 'capacity' THEN '' ELSE coalesce(value, '') END AS value, len(evidence) AS evidence_n FROM led WHERE erased OR reason = 'capacity'"),
    "ledger_episodes": _sql("led", "SELECT DISTINCT episode_id FROM led WHERE coalesce(episode_id, '') <> ''"),
    "raw_upsert": _sql("raw", "SELECT reference_id, episode_id, coalesce(turn_index, -1) AS turn_index, coalesce(user_msg, '') AS user_msg FROM raw"),
    "archive_upsert": _sql("archive", "SELECT summary_id, episode_id, seq, archive_reason, is_overridden FROM archive"),
    "active_remaining": _sql("active", "SELECT summary_id, episode_id, seq, index_id FROM active"),
    "duplicate_ids": _sql("summaries", "SELECT count(*) AS n, count(DISTINCT summary_id) AS n_distinct FROM summaries"),
    "table_counts": _sql(
        "raw archive active entries led probes",
        "SELECT 'raw_records' AS table_name, count(*) AS n FROM raw UNION ALL SELECT 'archived_summaries', count(*) FROM archive UNION ALL SELECT 'active_summaries', count(*) FROM active UNION ALL SELECT 'index_entries', count(*) FROM entries UNION ALL SELECT 'fact_ledger', count(*) FROM led UNION ALL SELECT 'probe_predictions', count(*) FROM probes",
    ),
    "resume_antijoin": "SELECT DISTINCT system, episode_id FROM probe_predictions WHERE run_id IS NOT NULL AND probe_index IS NOT NULL AND system IS NOT NULL AND episode_id IS NOT NULL EXCEPT SELECT system, episode_id FROM probe_predictions WHERE run_id = 'run-nightly' AND probe_index IS NOT NULL",
    "i1_conservation": _sql("lost", "SELECT * FROM lost"),
    "i2_reachability": _sql("unreach", "SELECT * FROM unreach"),
    "i3_provenance": _sql("unres", "SELECT * FROM unres"),
    "i5_deletion": _sql("undone", "SELECT * FROM undone"),
    "audit_report": _sql("report", "SELECT *, missing + unreachable + unresolved + without_evidence + value_kept + evidence_resolves = 0 AS clean FROM report"),
    "audit_all": _sql(
        "report",
        """SELECT count(*) AS episodes, count_if(missing + unreachable + unresolved + without_evidence + value_kept + evidence_resolves = 0) AS clean_episodes,
        count_if(missing > 0) AS i1_failures, count_if(unreachable > 0) AS i2_failures, count_if(unresolved + without_evidence > 0) AS i3_failures, count_if(value_kept + evidence_resolves > 0) AS i5_failures,
        CAST(sum(facts) AS BIGINT) AS ledger_facts, CAST(sum(erased_facts) AS BIGINT) AS erased_facts, CAST(sum(residual_mentions) AS BIGINT) AS residual_mentions, CAST(sum(unreachable) AS BIGINT) AS unreachable_values FROM report""",
    ),
    "silent_loss": _sql(
        "gold lost",
        f"""SELECT g.episode_id, count(*) AS gold_facts, count(k.key) AS captured FROM (SELECT DISTINCT episode_id, slot, key FROM gold) g
        LEFT JOIN (SELECT DISTINCT episode_id, slot, {_key('value')} AS key FROM led WHERE summary_id IN (SELECT summary_id FROM summaries)) k
        ON g.episode_id = k.episode_id AND g.slot = k.slot AND g.key = k.key GROUP BY ALL""",
    ),
    "residual_mentions": _sql(
        "led active entries",
        f"""SELECT l.episode_id, fact_id, count(*) AS mentions FROM led l JOIN (SELECT episode_id, text FROM active UNION ALL SELECT episode_id, title FROM entries) t
        ON t.episode_id = l.episode_id AND contains(t.text, l.value) WHERE reason = 'overridden' AND NOT erased AND length({_key('l.value')}) >= 2 GROUP BY ALL""",
    ),
    "erasure_plan": _sql(
        "led",
        """SELECT DISTINCT r AS reference_id, CASE WHEN r IN (SELECT unnest(evidence) FROM led WHERE reason <> 'capacity' AND NOT erased) THEN 'keep' ELSE 'delete' END AS action
        FROM (SELECT unnest(evidence) AS r FROM led WHERE reason = 'capacity')""",
    ),
    "gold_trace": _sql(
        "gold raw active entries",
        """SELECT g.episode_id, slot, layer, count(*) AS hits FROM (SELECT episode_id, slot, value FROM gold) g
        JOIN (SELECT 'raw' AS layer, episode_id, user_msg AS text FROM raw UNION ALL SELECT 'archive', episode_id, text FROM archive
              UNION ALL SELECT 'active', episode_id, text FROM active UNION ALL SELECT 'index', episode_id, title FROM entries) t
        ON t.episode_id = g.episode_id AND contains(t.text, g.value) GROUP BY ALL""",
    ),
    "exact_lookup": _sql(
        "led active",
        """SELECT i.summary_id, CASE WHEN a.summary_id IS NOT NULL THEN 'archive' WHEN b.summary_id IS NOT NULL THEN 'active' ELSE 'missing' END AS found_in,
        coalesce(a.text, b.text, '') AS text FROM (SELECT DISTINCT summary_id FROM led WHERE summary_id IS NOT NULL) i
        LEFT JOIN archive a ON a.summary_id = i.summary_id LEFT JOIN active b ON b.summary_id = i.summary_id""",
    ),
    "fact_state": _sql(
        "led active",
        """SELECT l.episode_id, fact_id, CASE WHEN b.summary_id IS NOT NULL THEN 'live' WHEN a.summary_id IS NOT NULL THEN 'archived' ELSE 'missing' END AS state
        FROM led l LEFT JOIN archive a ON a.summary_id = l.summary_id LEFT JOIN active b ON b.summary_id = l.summary_id""",
    ),
    "evidence_join": _sql("led raw", "SELECT fact_id, r.reference_id, coalesce(turn_index, -1) AS turn_index, user_msg FROM (SELECT fact_id, unnest(evidence) AS e FROM led) l JOIN raw r ON r.reference_id = l.e"),
    "rendered_chain": _sql("unfiled", "SELECT summary_id, episode_id, seq FROM unfiled"),
    "expand_index": _sql(
        "entries active",
        """SELECT m.index_id, CAST(i - 1 AS INTEGER) AS position, m.summary_id, CASE WHEN b.summary_id IS NOT NULL THEN 'live' WHEN a.summary_id IS NOT NULL THEN 'archived' ELSE 'missing' END AS state
        FROM (SELECT index_id, i, members[i] AS summary_id FROM (SELECT index_id, members, unnest(range(1, len(members) + 1)) AS i FROM entries)) m
        LEFT JOIN archive a ON a.summary_id = m.summary_id LEFT JOIN active b ON b.summary_id = m.summary_id""",
    ),
    "predecessor_anchor": _sql(
        "placed",
        """SELECT episode_id, slot, value, fact_id, previous_value, previous_fact FROM (SELECT *, lag(key) OVER w AS pk, lag(value) OVER w AS previous_value, lag(fact_id) OVER w AS previous_fact FROM k
        WINDOW w AS (PARTITION BY episode_id, slot ORDER BY observed_turn, seq)) WHERE pk IS NOT NULL AND pk <> key""",
        f"k AS (SELECT *, {_key('value')} AS key FROM led WHERE NOT erased AND observed_turn IS NOT NULL AND slot IS NOT NULL AND episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id, slot, observed_turn, seq ORDER BY fact_id DESC) = 1)",
    ),
    "predecessor_fallback": _sql(
        "cur",
        f"""SELECT l.episode_id, l.slot, l.value, l.fact_id FROM led l JOIN cur c ON c.episode_id = l.episode_id AND c.slot = l.slot
        WHERE NOT l.erased AND l.observed_turn IS NOT NULL AND {_key('l.value')} <> '' AND {_key('l.value')} <> {_key('c.value')}
        QUALIFY row_number() OVER (PARTITION BY l.episode_id, l.slot ORDER BY l.observed_turn DESC, l.seq DESC, l.fact_id DESC) = 1""",
    ),
    "override_resolution": _sql(
        "led",
        """SELECT a.episode_id, a.summary_id, b.summary_id AS overrider, b.observed_turn AS at_turn FROM k a JOIN k b ON a.episode_id = b.episode_id AND a.slot = b.slot AND a.key <> b.key
        AND (b.observed_turn > a.observed_turn OR (b.observed_turn = a.observed_turn AND b.seq > a.seq))
        QUALIFY row_number() OVER (PARTITION BY a.episode_id, a.summary_id ORDER BY b.observed_turn, b.seq, b.summary_id) = 1""",
        f"k AS (SELECT episode_id, slot, observed_turn, seq, split_part(fact_id, '#', 1) AS summary_id, {_key('value')} AS key FROM led WHERE NOT erased AND observed_turn IS NOT NULL AND slot IS NOT NULL AND episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id, slot, observed_turn, seq ORDER BY fact_id DESC) = 1)",
    ),
    "override_ids": _sql(
        "summaries",
        f"""SELECT n.summary_id, n.ref, coalesce(k.target, '') AS target FROM n LEFT JOIN (SELECT {_EP.format('summary_id')} || '/' || {_SHORT.format('summary_id')} AS k, summary_id AS target FROM summaries) k
        ON k.k = {_EP.format('n.summary_id')} || '/' || {_SHORT.format('n.ref')}""",
        "n AS (SELECT DISTINCT summary_id, ref FROM (SELECT summary_id, unnest(override_ids) AS ref FROM archive UNION ALL SELECT summary_id, unnest(override_ids) FROM active) WHERE coalesce(ref, '') <> '')",
    ),
    "turn_ordinals": _sql("cost", "SELECT * FROM cost"),
    "sliding_window": _sql("raw", "SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY turn_index DESC, reference_id DESC) AS INTEGER) AS position, reference_id, turn_index FROM raw WHERE turn_index IS NOT NULL QUALIFY position <= 4"),
    "budget_suffix": _sql("cost", "SELECT episode_id, turn, cost, CAST(sum(cost) OVER (PARTITION BY episode_id ORDER BY turn DESC) AS BIGINT) AS total FROM cost QUALIFY total <= 200 OR total = cost"),
    "naive_chain_trim": _sql(
        "active",
        "SELECT episode_id, turn, cost, CAST(sum(cost) OVER (PARTITION BY episode_id ORDER BY turn DESC) AS BIGINT) AS total FROM c QUALIFY total <= 100",
        f"c AS (SELECT episode_id, seq AS turn, CAST(sum({_tokens(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS BIGINT) AS cost FROM active WHERE seq >= 0 GROUP BY ALL)",
    ),
    "full_context_prefix": _sql("cost", "SELECT episode_id, turn, cost, CAST(sum(cost) OVER (PARTITION BY episode_id ORDER BY turn) AS BIGINT) AS total FROM cost QUALIFY total <= 300"),
    "baseline_tokens": _sql("cost", "SELECT episode_id, count(*) AS turns, CAST(sum(t) AS BIGINT) AS shown_tokens, CAST(max(t) AS BIGINT) AS most_tokens FROM (SELECT episode_id, sum(cost) OVER (PARTITION BY episode_id ORDER BY turn) AS t FROM cost) GROUP BY ALL"),
    "evicted_at_end": _sql(
        "cost",
        """SELECT c.episode_id, count(*) AS evicted, CAST(sum(cost) AS BIGINT) AS evicted_tokens FROM cost c WHERE episode_id IN (SELECT episode_id FROM cost GROUP BY ALL HAVING sum(cost) > 400)
        AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.episode_id = c.episode_id AND k.turn_index = c.turn) GROUP BY ALL""",
        "kept AS (SELECT episode_id, turn_index FROM raw WHERE turn_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY turn_index DESC, reference_id DESC) <= 4)",
    ),
    "spread_sample": _sql(
        "cost",
        """SELECT * FROM cost c WHERE EXISTS (SELECT 1 FROM (SELECT episode_id, unnest(list_transform(range(0, 5), lambda i: (i * count(*)) // 5)) AS t FROM cost GROUP BY episode_id) w
        WHERE w.episode_id = c.episode_id AND w.t = c.turn)""",
    ),
    "evidence_truncation": _sql(
        "cost led",
        """SELECT episode_id, turn, CAST(e AS INTEGER) AS is_evidence FROM (SELECT c.episode_id, c.turn, EXISTS (SELECT 1 FROM led l WHERE l.episode_id = c.episode_id AND l.observed_turn = c.turn) AS e FROM cost c)
        QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY e DESC, turn DESC) <= 10""",
    ),
    "episode_metrics": _sql(
        "active",
        f"""SELECT coalesce(a.episode_id, b.episode_id) AS episode_id, coalesce(active, 0) AS active, coalesce(active_tokens, 0) AS active_tokens, coalesce(filed, 0) AS filed, coalesce(archived, 0) AS archived, coalesce(overridden, 0) AS overridden, coalesce(merged, 0) AS merged
        FROM (SELECT episode_id, count(*) AS active, CAST(coalesce(sum({_tokens('text')}), 0) AS BIGINT) AS active_tokens, count_if(coalesce(index_id, '') <> '') AS filed FROM active GROUP BY ALL) a
        FULL JOIN (SELECT episode_id, count(*) AS archived, count_if(archive_reason = 'overridden') AS overridden, count_if(origin = 'capacity_merge') AS merged FROM archive GROUP BY ALL) b ON a.episode_id = b.episode_id""",
    ),
    "token_accounting": _sql(
        "unfiled",
        f"""SELECT episode_id, layer, count(*) AS lines, CAST(sum({_tokens('line')}) AS BIGINT) AS tokens FROM (
        SELECT episode_id, 'chain' AS layer, '- ' || {_SHORT.format('summary_id')} || ' ' || coalesce(text, '') AS line FROM unfiled
        UNION ALL SELECT episode_id, 'index', '* ' || {_SHORT.format('index_id')} || ' ' || coalesce(title, '') FROM entries) GROUP BY ALL""",
    ),
    "protected_set": _sql("pairs", "SELECT DISTINCT episode_id, summary_id FROM (SELECT episode_id, summary_id FROM pairs WHERE live QUALIFY row_number() OVER (PARTITION BY episode_id, lower(slot) ORDER BY seq DESC, summary_id DESC) = 1)"),
    "fact_digest": _sql(
        "pairs entries",
        """SELECT index_id, slot, slot || '=' || v[-1] || CASE WHEN len(v) > 1 THEN '[' || array_to_string(v[greatest(len(v) - 3, 1):len(v) - 1], '→') || '→' || v[-1] || ']' ELSE '' END AS digest
        FROM (SELECT index_id, slot, list(value ORDER BY seq, value) AS v FROM (SELECT index_id, slot, value, min(seq) AS seq FROM
          (SELECT DISTINCT index_id, unnest(members) AS summary_id FROM entries) m JOIN pairs USING (summary_id) GROUP BY ALL) GROUP BY ALL)""",
    ),
    "token_estimate": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "message_tokens": _sql("raw", f"""SELECT episode_id, CAST(sum({_tokens("coalesce(user_msg, '')")} + {_tokens("coalesce(agent_msg, '')")} + 10) + 2 AS BIGINT) AS tokens FROM raw GROUP BY ALL"""),
    "fact_pairs": _sql("pairs", "SELECT DISTINCT summary_id, slot, value FROM pairs"),
    "made_ids": _sql(
        "raw",
        f"""SELECT reference_id, episode_id || '/raw' || printf('%03d', turn_index) || '@' || substr(sha1(episode_id || ':raw:' || turn_index || ':'), 1, 6) AS made, {_SHORT.format('reference_id')} AS short FROM raw WHERE turn_index IS NOT NULL""",
    ),
    "fact_episodes": _sql("led", f"SELECT fact_id, {_EP.format(chr(115) + 'plit_part(fact_id, ' + chr(39) + '#' + chr(39) + ', 1)')} AS episode, episode = episode_id AS same FROM led"),
    "previews": _sql(
        "active",
        rf"""SELECT summary_id, substr(b, 1, 26) || CASE WHEN length(b) > 26 THEN '…' ELSE '' END AS preview FROM (SELECT summary_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\[(?:FACTS|OVERRIDES)[^\]]*\]', ' ', 'g'), '[{_SP}]+', ' ', 'g')) AS b FROM active)""",
    ),
    "normalised_values": _sql("led", rf"""SELECT fact_id, {_key('value')} AS key, translate(regexp_replace(lower(coalesce(value, '')), '[{_SP}]', '', 'g'), '。.,;；:：!！?？"''“”‘’()（）[]【】', '') AS plain FROM led"""),
    "metrics_by_system": _sql(
        "probes",
        "SELECT system, count(DISTINCT (run_id, episode_id)) AS episodes, count(*) AS probes, "
        + ", ".join(f"count_if(probe_type = '{k}') AS {n}_n, CAST(sum(CASE WHEN probe_type = '{k}' THEN coalesce(correct, 0) ELSE 0 END) AS BIGINT) AS {n}_correct" for k, n in (("current_fact", "current"), ("history_fact", "history"), ("memory_point", "memory_point"), ("no_history", "no_history")))
        + ", CAST(sum(tool_attempted) AS BIGINT) AS tool_calls, CAST(sum(tool_resolved) AS BIGINT) AS tool_resolved, CAST(sum(tool_unparsable) AS BIGINT) AS tool_unparsable, count(context_tokens) AS context_n, CAST(sum(context_tokens) AS BIGINT) AS context_tokens, count(error) AS errors FROM probes GROUP BY system",
    ),
    "error_breakdown": _sql("probes", "SELECT system, probe_type, judge_method, CASE WHEN correct = 1 THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM probes GROUP BY ALL"),
    "per_episode_accuracy": _sql(
        "probes",
        "SELECT system, episode_id, "
        + ", ".join(f"count_if(probe_type = '{k}' AND correct = 1) AS {n}_correct, count_if(probe_type = '{k}') AS {n}_n" for k, n in (("current_fact", "current"), ("history_fact", "history"), ("memory_point", "memory_point"), ("no_history", "no_history")))
        + " FROM probes GROUP BY system, episode_id",
    ),
    "runs_union": _sql("probes", "SELECT coalesce(system, '*') AS system, coalesce(probe_type, '*') AS probe_type, count(*) AS n, CAST(sum(coalesce(correct, 0)) AS BIGINT) AS correct_n FROM probes GROUP BY CUBE (system, probe_type)"),
    "dataset_inspect": _sql(
        "raw probes",
        """SELECT count(*) AS episodes, CAST(sum(turns) AS BIGINT) AS turns, max(turns) AS most_turns, CAST(sum(probes) AS BIGINT) AS probes, count_if(probes IS NULL) AS without_probes
        FROM (SELECT episode_id, count(*) AS turns FROM raw WHERE turn_index IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT episode_id, count(DISTINCT probe_index) AS probes FROM probes GROUP BY ALL) USING (episode_id)""",
    ),
    "turn_pairs": _sql(
        "raw",
        """SELECT episode_id, count(*) AS pairs, count_if(role = 'agent') AS orphans FROM (SELECT *, lag(role) OVER (PARTITION BY episode_id ORDER BY at_) AS b FROM said) WHERE role = 'user' OR coalesce(b, '') <> 'user' GROUP BY ALL""",
        """one AS (SELECT * FROM raw WHERE turn_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id, turn_index ORDER BY ts DESC NULLS LAST, reference_id DESC) = 1),
        said AS (SELECT episode_id, turn_index * 2 AS at_, 'user' AS role FROM one WHERE coalesce(user_msg, '') <> '' UNION ALL SELECT episode_id, turn_index * 2 + 1, 'agent' FROM one WHERE coalesce(agent_msg, '') <> '')""",
    ),
    "time_labels": _sql("entries", "SELECT index_id, 'turn ' || turn_start || CASE WHEN turn_start = turn_end THEN '' ELSE '-' || turn_end END AS label, substr(title, 1, 120) AS title FROM entries"),
}


def _answer(c: str) -> str:
    low = f"lower({_strip(f'translate(coalesce({c}, {_q(str())}), {_q(_WIDE)}, {_q(_PLAIN)})')})"
    low = rf"regexp_replace({low}, '^(答案|answer|结论)[ \t]*[:：][ \t]*', '')"
    return f"""translate(regexp_replace({low}, '[{_SP}]', '', 'g'), '。，,.;；:：!！?？"''“”‘’()（）[]【】', '')"""


SQL["string_match_score"] = _sql(
    "probes",
    """SELECT system, probe_type, judge_method, count_if(p <> '' AND g <> '' AND (p = g OR ph = gh OR (pb <> '' AND gb <> '' AND starts_with(pb, gb))
      OR (length(g) >= 2 AND starts_with(ph, g)) OR (length(gh) >= 2 AND starts_with(ph, gh)))) AS matched, count_if(correct = 1) AS judged, count(*) AS n
    FROM c GROUP BY system, probe_type, judge_method""",
    f"""a AS (SELECT system, probe_type, judge_method, correct, {_answer('prediction')} AS p, {_answer('gold')} AS g FROM probes),
    b AS (SELECT *, regexp_replace(p, '^(答案是|答案|是)+', '') AS ph, regexp_replace(g, '^(答案是|答案|是)+', '') AS gh FROM a),
    c AS (SELECT *, CASE WHEN substr(ph, 1, 1) IN ('a', 'b', 'c', 'd') THEN substr(ph, 2) ELSE ph END AS pb, CASE WHEN substr(gh, 1, 1) IN ('a', 'b', 'c', 'd') THEN substr(gh, 2) ELSE gh END AS gb FROM b)""",
)

# --- gate and extraction: the same patterns, read by RE2 ---


def _pairs_sql(c: str) -> str:
    """List of {slot, value} structs of the candidate pairs of a text."""
    pad = T._PAD.replace("'", "''")
    trim = lambda x, n: f"lower(substr(regexp_replace({x}, '^{pad}+|{pad}+$', '', 'g'), 1, {n}))"
    lists = []
    for pattern, slot, value in T.STATEMENTS:
        p = _q(pattern)
        values = f"regexp_extract_all({c}, {p}, {value})"
        slots = f"regexp_extract_all({c}, {p}, {slot})" if slot else f"list_transform({values}, lambda v: '')"
        lists.append(f"list_transform(list_zip({slots}, {values}), lambda z: {{'slot': {trim('z[1]', 24)}, 'value': {trim('z[2]', 40)}}})")
    again = f"CASE WHEN regexp_matches({c}, {_q(T.EN_CHANGE)}) THEN list_transform(regexp_extract_all({c}, {_q(T.RESTATED)}, 1), lambda v: {{'slot': '', 'value': {trim('v', 40)}}}) ELSE [] END"
    lists.append(again)
    joined = lists[0]
    for more in lists[1:]:
        joined = f"list_concat({joined}, {more})"
    return f"list_filter(list_distinct({joined}), lambda p: p.value <> '')"


_W0, _W1 = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_ASKS = rf"(?i)[?？]|{_W0}(how|what|which|why|when|where|who|whose|whom|can you|could you|do i|did i|does|is it|are there){_W1}|怎么|什么|哪|多少|吗|呢|如何|是否"
_OVER, _FACT = r"(?is)\[\s*OVERRIDES\s*[:：]\s*([^\]\[]*?)\s*\]", r"(?is)\[\s*FACTS\s*[:：]\s*([^\]\[]*?)\s*\]"
_KIND = f"""CASE WHEN regexp_matches(t, {_q(T._ZH_CHANGE)}) OR regexp_matches(t, {_q(T.EN_CHANGE)}) OR regexp_matches(t, {_q(T.STATEMENTS[-1][0])}) THEN 'change'
  WHEN len(pairs) > 0 THEN 'state' ELSE 'none' END"""
_SIGNALS = f"""t0 AS (SELECT episode_id, turn_index AS turn, reference_id, coalesce(user_msg, '') AS t FROM raw WHERE turn_index IS NOT NULL),
t1 AS (SELECT *, {_pairs_sql('t')} AS pairs FROM t0),
sig AS (SELECT episode_id, turn, reference_id, {_KIND} AS kind, regexp_matches(t, {_q(_ASKS)}) AS asks, pairs FROM t1)"""
_GATED = (
    _SIGNALS
    + """,
each AS (SELECT episode_id, turn, unnest(pairs) AS p FROM sig),
fst AS (SELECT episode_id, p.value AS value, min(turn) AS first FROM each GROUP BY ALL),
nov AS (SELECT e.episode_id, e.turn, max(CAST(f.first = e.turn AS INTEGER)) = 1 AS novel FROM each e JOIN fst f ON f.episode_id = e.episode_id AND f.value = e.p.value GROUP BY ALL),
gated AS (SELECT s.episode_id, s.turn, s.reference_id, kind = 'change' OR (kind = 'state' AND NOT asks) AS keep_pattern,
  CASE WHEN kind = 'change' THEN coalesce(novel, false) OR len(pairs) = 0 ELSE coalesce(novel, false) AND NOT asks END AS keep_strict
  FROM sig s LEFT JOIN nov n ON n.episode_id = s.episode_id AND n.turn = s.turn)"""
)
_TRUTH = "(SELECT DISTINCT unnest(evidence) AS reference_id FROM led)"
SQL |= {
    "gate_classify": _sql("raw", "SELECT episode_id, kind, asks, count(*) AS n FROM sig GROUP BY ALL", _SIGNALS),
    "candidate_pairs": _sql("raw", "SELECT DISTINCT reference_id, p.slot AS slot, p.value AS value FROM (SELECT reference_id, unnest(pairs) AS p FROM sig)", _SIGNALS),
    "gate_strict_first_seen": _sql("raw", "SELECT episode_id, count_if(keep_pattern) AS pattern, count_if(keep_strict) AS strict, count(*) AS turns FROM gated GROUP BY ALL", _GATED),
    "gate_confusion": _sql(
        "raw led",
        " UNION ALL ".join(
            f"SELECT '{level}' AS level, count_if(k AND f) AS tp, count_if(k AND NOT f) AS fp, count_if(NOT k AND f) AS fn, count_if(NOT k AND NOT f) AS tn FROM (SELECT keep_{level} AS k, e.reference_id IS NOT NULL AS f FROM gated g LEFT JOIN {_TRUTH} e ON e.reference_id = g.reference_id)"
            for level in ("pattern", "strict")
        ),
        _GATED,
    ),
    "gate_prevalence": _sql(
        "raw led",
        f"SELECT e.reference_id IS NOT NULL AS fact, count(*) AS turns, count_if(len(pairs) > 0) AS with_pairs, count_if(kind = 'change') AS changes, count_if(asks) AS questions FROM sig s LEFT JOIN {_TRUTH} e ON e.reference_id = s.reference_id GROUP BY ALL",
        _SIGNALS,
    ),
    "i4_extraction": _sql(
        "raw led",
        f"""SELECT episode_id, count_if(strict) AS strict_candidates, count_if(strict AND hit) AS strict_captured, count(*) AS all_candidates, count_if(hit) AS all_captured FROM (
        SELECT f.episode_id, kind = 'change' AS strict, coalesce(list_contains(list_transform(held, lambda h: h <> '' AND x <> '' AND (h = x OR (length(x) >= 2 AND length(h) >= 2 AND (contains(h, x) OR contains(x, h))))), true), false) AS hit
        FROM (SELECT episode_id, turn, kind, {_key('p.value')} AS x FROM (SELECT episode_id, turn, kind, unnest(pairs) AS p FROM sig)) f
        LEFT JOIN (SELECT episode_id, observed_turn AS turn, list(DISTINCT {_key('value')}) AS held FROM led WHERE observed_turn IS NOT NULL GROUP BY ALL) h ON h.episode_id = f.episode_id AND h.turn = f.turn) GROUP BY episode_id""",
        _SIGNALS,
    ),
}

_STOPS = """the a an of to and or in on at is are was were be been i my me you your it its for with that this these those as by from not no do does did have has had will would can could should
now then than there here what which who whom whose when where why how if but so about into over after before also very just""".split()
_TRIM_FACT = r"[，,。.；;:： \t\n]"
_LIST = "array_to_string({}, '{}')"
SQL |= {
    "summary_grammar": _sql(
        "summaries",
        rf"""SELECT summary_id, body, coalesce(array_to_string(list_distinct_in_order, ';'), '') AS facts,
        array_to_string(list_filter(flatten(list_transform(regexp_extract_all(text, {_q(_OVER)}, 1), lambda p: regexp_split_to_array(p, '[,，;；\s]+'))), lambda i: lower(i) NOT IN ('none', 'null', '无', '空', '-', 'n/a', 'na', '')), ',') AS overrides,
        regexp_matches(text, {_q(_OVER)}) AS has_tag FROM (
        SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_in_order FROM (
        SELECT summary_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {_q(_FACT)}, '', 'g'), {_q(_OVER)}, '', 'g'), '^\s*```[a-zA-Z]*\s*|\s*```\s*$', '', 'g'), '(?i)^\s*(?:摘要|summary)\s*[:：]\s*', ''), '^[` \n\t\r]+|[` \n\t\r]+$', '', 'g') AS body,
        list_transform(list_filter(list_transform(list_filter(flatten(list_transform(regexp_extract_all(text, {_q(_FACT)}, 1), lambda p: regexp_split_to_array(p, '[;；|]'))), lambda c: contains(c, '=')),
          lambda c: {{'k': regexp_replace(split_part(c, '=', 1), '^{_TRIM_FACT}+|{_TRIM_FACT}+$', '', 'g'), 'v': regexp_replace(substr(c, instr(c, '=') + 1), '^{_TRIM_FACT}+|{_TRIM_FACT}+$', '', 'g')}}),
          lambda p: lower(p.k) NOT IN ('none', 'null', '无', '空', '-', 'n/a', 'na', '')), lambda p: CASE WHEN p.v <> '' THEN p.k || '=' || p.v ELSE p.k END) AS f
        FROM summaries WHERE text IS NOT NULL))""",
    ),
    "fact_slots": _sql(
        "summaries",
        rf"""SELECT DISTINCT summary_id, slot FROM (SELECT summary_id, unnest(list_transform(regexp_extract_all(text, {_q(T.FACT_PAIR)}, 1),
        lambda s: lower(regexp_replace(regexp_replace(s, '^[{_SP}]*[，,。.；;:：\-–— ]*|[，,。.；;:：\-–— ]*[{_SP}]*$', '', 'g'), '(?i)^facts?[ \t]*[:：][ \t]*', '')))) AS slot FROM summaries) WHERE slot <> '' AND length(slot) <= 30""",
    ),
    "question_overlap": _sql(
        "probes",
        rf"""SELECT run_id, system, episode_id, probe_index, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(floor(len(list_intersect(a, b)) / len(a) * 1000) AS INTEGER) ELSE 0 END AS overlap_permille,
        x <> '' AND y <> '' AND (x = y OR (length(x) >= 4 AND contains(y, x)) OR (length(y) >= 4 AND contains(x, y))) AS names_slot FROM (
        SELECT *, list_filter(list_distinct(regexp_extract_all(lower(question), '([a-z0-9\x{{4E00}}-\x{{9FFF}}]+)', 1)), lambda w: w NOT IN ({', '.join(map(_q, _STOPS))})) AS a, list_filter(list_distinct(regexp_extract_all(lower(prediction), '([a-z0-9\x{{4E00}}-\x{{9FFF}}]+)', 1)), lambda w: w NOT IN ({', '.join(map(_q, _STOPS))})) AS b, {_key('fact_key')} AS x, {_key('question')} AS y
        FROM probes WHERE question IS NOT NULL AND prediction IS NOT NULL)""",
    ),
}


_S = r"[ \t]"
_FORMS = (  # group of the slot, of the anchor
    (rf"(?i)^{_S}*before{_S}+(?:it{_S}+)?(?:became|was|changed{_S}+to){_S}+(.+?){_S}*,{_S}*(?:what|which){_S}+(?:was|were|is|are){_S}+(?:my|the|your){_S}+(.+?){_S}*[?？.]?{_S}*$", 2, 1),
    (rf"(?i)^{_S}*(?:what|which){_S}+(?:was|were){_S}+(?:my|the|your){_S}+(.+?){_S}+before{_S}+(?:it{_S}+)?(?:became|was|changed{_S}+to){_S}+(.+?){_S}*[?？.]?{_S}*$", 1, 2),
    (rf"(?i)^{_S}*(?:what|which){_S}+(?:was|were){_S}+(?:my|the|your){_S}+(.+?){_S}+(?:originally|previously|earlier){_S}*[?？.]?{_S}*$", 1, 0),
    (rf"^{_S}*在?(?:改成|变成|改为|调整到|调到){_S}*(.+?){_S}*(?:之前|以前)[，,]?{_S}*我(?:的)?(.+?)(?:是什么|是多少|是几|在哪儿|在哪里|在几楼|在几层|几点|呢|吗)?{_S}*[?？。]?{_S}*$", 2, 1),
    (rf"^{_S}*我(?:原来|以前|之前|原本)的(.+?)(?:是什么|是多少|是几|在哪儿|在哪里|在几楼|在几层|几点|呢|吗){_S}*[?？。]?{_S}*$", 1, 0),
    (rf"(?i)^{_S}*(?:what|which){_S}+(.+?){_S}+did{_S}+I{_S}+have{_S}+before{_S}+(.+?){_S}*[?？.]?{_S}*$", 1, 2),
    (rf"(?i)^{_S}*(?:what|which){_S}+(.+?){_S}+did{_S}+I{_S}+mention{_S}+in{_S}+(turn{_S}+[0-9]+){_S}*[?？.]?{_S}*$", 1, 2),
    (rf"(?i)^{_S}*(?:what|which)(?:'s|{_S}+(?:is|are|was|were)){_S}+(?:my|the|your){_S}+(.+?)(?:{_S}+(?:now|currently|right now|these days))?{_S}*[?？.]?{_S}*$", 1, 0),
    (rf"^{_S}*(第[0-9]+轮)提到的(.+?)(?:是什么|是多少|是几|在哪儿|在哪里|在几楼|在几层|几点|呢|吗)?{_S}*[?？。]?{_S}*$", 2, 1),
    (rf"^{_S}*我(?:现在)?的(.+?)(?:是什么|是多少|是几|在哪儿|在哪里|在几楼|在几层|几点|呢|吗)?{_S}*[?？。]?{_S}*$", 1, 0),
)


def _question(group: int) -> str:
    cases = []
    for pattern, slot, anchor in _FORMS:
        g = (slot, anchor)[group]
        cases.append(f"WHEN regexp_matches(question, {_q(pattern)}) THEN " + (f"regexp_extract(question, {_q(pattern)}, {g})" if g else "''"))
    return "CASE " + " ".join(cases) + " ELSE '' END"


def _clean_slot(c: str) -> str:
    out = f"lower({_strip(f'coalesce({c}, {_q(str())})')})"
    for _ in range(3):
        out = rf"regexp_replace({out}, '\b(has|have|had|is|are|was|were|been)\s+(changed|updated|switched|moved)(\s+(to|into))?|\b(changed|updated|switched|moved|it|now|anymore|again|actually|just|sorry)\b|改成|改到|调到|改为|变成|更新为|现在|已经|又', ' ', 'g')"
        out = rf"trim(regexp_replace({out}, '[\s\-–—_]+', ' ', 'g'))"
        for cut in (r"^(my|the|your|我的|我)\s*", r"^(喜欢|爱|讨厌)(的)?\s*", r"(是什么|是多少|是几|在哪儿|在哪里|在哪|在什么|叫啥|叫什么|多少钱|呢|吗)([一二三四五六七八九十百千0-9]+[层楼])?\s*$", r"在[一二三四五六七八九十百千0-9]+[层楼]\s*$", r"[\s:：,，。.]+$"):
            out = f"trim(regexp_replace({out}, '{cut}', ''))"
    return out


def _clean_value(c: str) -> str:
    edge = lambda x: rf"regexp_replace({x}, '^[。.,，;；!！?？\"''“” \t\n]+|[。.,，;；!！?？\"''“” \t\n]+$', '', 'g')"
    out = edge(f"coalesce({c}, '')")
    for _ in range(3):
        out = rf"regexp_replace({out}, '^([在是为到了]|((?i)is|are|was|were|the|a|an)\b)\s*', '')"
        out = edge(rf"regexp_replace({out}, '(?i)(了|呢|吗|的|now|please|ok|okay)[。.!！?？]*$', '')")
    return out


SQL |= {
    "question_slots": _sql(
        "probes",
        f"""SELECT question, fact_key, slot, anchor, x <> '' AND y <> '' AND (x = y OR (length(x) >= 4 AND contains(y, x)) OR (length(y) >= 4 AND contains(x, y))) AS same FROM (
        SELECT *, {_key('slot')} AS x, {_key('fact_key')} AS y FROM (SELECT question, coalesce(fact_key, '') AS fact_key, {_clean_slot('s')} AS slot, {_clean_value('a')} AS anchor
        FROM (SELECT question, fact_key, {_question(0)} AS s, {_question(1)} AS a FROM (SELECT DISTINCT question, fact_key FROM probes WHERE question IS NOT NULL))))""",
    ),
    "judge_words": _sql(
        "probes",
        r"""SELECT reason, CASE WHEN regexp_matches(lower(reason), '\b(correct|yes)\b|^对的$|^正确$') THEN 'true' WHEN regexp_matches(lower(reason), '\b(incorrect|wrong|no)\b|^错误$|^不正确$') THEN 'false' ELSE 'nothing' END AS verdict, count(*) AS n
        FROM (SELECT coalesce(judge_reason, '') AS reason FROM probes) GROUP BY ALL""",
    ),
    "rendered_lines": _sql(
        "unfiled",
        f"""SELECT episode_id, summary_id AS id, '- ' || {_SHORT.format('summary_id')} || ' [OVERRIDES: ' || coalesce(nullif(array_to_string(list_transform(override_ids, lambda i: {_SHORT.format('i')}), ','), ''), 'none') || '] ' || coalesce(text, '') AS line FROM unfiled
        UNION ALL SELECT episode_id, index_id, '* ' || {_SHORT.format('index_id')} || ' (turns ' || coalesce(CAST(turn_start AS VARCHAR), '?') || '-' || coalesce(CAST(turn_end AS VARCHAR), '?') || ') ' || coalesce(substr(title, 1, 120), '') FROM entries""",
    ),
}

_OPEN, _SHUT = r"<\s*MEMORY_UPDATE\s*>", r"<\s*/\s*MEMORY_UPDATE\s*>"
_HAS = "(contains(upper({0}), '[OVERRIDES') OR contains(upper({0}), '[FACTS'))"
SQL["self_written"] = _sql(
    "probes",
    rf"""SELECT prediction, CASE WHEN v <> '' THEN v WHEN body <> '' THEN body ELSE u END AS answer, body, coalesce(array_to_string(f, ';'), '') AS facts FROM (
    SELECT prediction, {_strip('v')} AS v, u, trim({_strip(f"regexp_replace(regexp_replace(u, {_q(_FACT)}, '', 'g'), {_q(_OVER)}, '', 'g')")}, e'` \n\t\r') AS body,
      list_transform(list_filter(regexp_split_to_array(array_to_string(regexp_extract_all(u, {_q(_FACT)}, 1), ';'), '[;；|]'), lambda x: contains(x, '=')), lambda x: trim(split_part(x, '=', 1)) || '=' || trim(substr(x, instr(x, '=') + 1), ' .。,，')) AS f
    FROM (SELECT prediction, CASE WHEN {_HAS.format('tail')} THEN head ELSE left_over END AS v, {_strip(f"coalesce(list_filter(list_concat(blocks, [CASE WHEN {_HAS.format('tail')} THEN tail ELSE '' END]), lambda x: trim(x, e' \\n\\t') <> '')[1], '')")} AS u
      FROM (SELECT *, regexp_extract(left_over, '(?is)^(.*){_OPEN}(.*)$', 1) AS head, regexp_extract(left_over, '(?is)^(.*){_OPEN}(.*)$', 2) AS tail
        FROM (SELECT prediction, regexp_replace(prediction, '(?is){_OPEN}.*?{_SHUT}', '', 'g') AS left_over, regexp_extract_all(prediction, '(?is){_OPEN}(.*?){_SHUT}', 1) AS blocks
          FROM (SELECT DISTINCT prediction FROM probes WHERE contains(lower(prediction), '<memory_update>'))))))""",
)

_SAY = r"(改为|改成|改到|变成|变为|更新为|现在是|现在为|更改为)[ \t]*([^，,。.;；\n]{1,40})"
_BARE = r"regexp_replace({}, '^[。.,;；!！?？\"''“”\s]+|[。.,;；!！?？\"''“”\s]+$', '', 'g')"
SQL |= {
    "cleaned_slots": _sql("led", f"SELECT slot, value, {_clean_slot('slot')} AS clean_slot, {_clean_value('value')} AS clean_value FROM (SELECT DISTINCT coalesce(slot, '') AS slot, coalesce(value, '') AS value FROM led)"),
    "slot_values": _sql(
        "pairs",
        rf"""SELECT DISTINCT summary_id, name AS slot, coalesce(given, CASE WHEN contains(low, name) THEN coalesce(said, {_BARE.format("split_part(regexp_replace(tail, '^[\\s=:：\\-–—]+', ''), ';', 1)")}) END, '') AS value FROM (
        SELECT *, list_filter(list_transform(regexp_extract_all(low, '[^=;|\n]+=[^;|\n]+'), lambda w: CASE WHEN contains(split_part(w, '=', 1), name) THEN {_BARE.format("substr(w, instr(w, '=') + 1)")} ELSE '' END), lambda v: v <> '')[1] AS given,
          {_BARE.format(f"regexp_extract_all(tail, {_q(_SAY)}, 2)[-1]")} AS said
        FROM (SELECT summary_id, name, low, substr(low, instr(low, name) + length(name)) AS tail FROM (SELECT p.summary_id, lower(p.slot) AS name, lower(s.text) AS low FROM pairs p JOIN summaries s ON s.summary_id = p.summary_id AND s.text IS NOT NULL)))""".replace("\\\\", "\\"),
    ),
    "override_whitelist": _sql(
        "summaries",
        rf"""SELECT e.summary_id, count(*) AS given, count(DISTINCT CASE WHEN k.ref IS NOT NULL THEN e.ref END) AS accepted, count_if(k.ref IS NULL) AS invalid FROM e
        LEFT JOIN (SELECT DISTINCT episode_id, split_part(summary_id, '/', -1) AS ref FROM summaries) k ON k.episode_id = e.episode_id AND k.ref = e.ref GROUP BY e.summary_id""",
        rf"""e AS (SELECT summary_id, episode_id, ref FROM (SELECT summary_id, episode_id, unnest(flatten(list_transform(regexp_extract_all(text, {_q(_OVER)}, 1), lambda p: regexp_split_to_array(p, '[,，;；\s]+')))) AS ref FROM summaries WHERE text IS NOT NULL)
        WHERE lower(ref) NOT IN ('none', 'null', '无', '空', '-', 'n/a', 'na', ''))""",
    ),
    "resume_union": _sql(
        "probes",
        """SELECT system, episode_id, CAST(sum(CASE WHEN run_id = 'run-nightly' THEN 1 ELSE 0 END) AS BIGINT) AS probes, CAST(sum(CASE WHEN run_id = 'run-nightly' THEN coalesce(correct, 0) ELSE 0 END) AS BIGINT) AS correct,
        CASE WHEN bool_or(run_id = 'run-nightly') THEN 'done' ELSE 'pending' END AS state FROM probes GROUP BY system, episode_id""",
    ),
    "validated_intake": f"""WITH g AS (SELECT episode_id, {_strip("coalesce(slot, '')")} AS slot, {_strip("coalesce(value, '')")} AS value, {_strip("coalesce(summary_id, '')")} AS summary_id FROM fact_ledger WHERE episode_id IS NOT NULL),
      n AS (SELECT DISTINCT episode_id, summary_id || '#' || slot AS f FROM g WHERE slot <> '' AND value <> '' AND summary_id <> ''),
      a AS (SELECT episode_id, count(*) AS added FROM n WHERE f NOT IN (SELECT fact_id FROM fact_history WHERE fact_id IS NOT NULL) GROUP BY ALL)
      SELECT episode_id, accepted, rejected, coalesce(added, 0) AS added, accepted - coalesce(added, 0) AS duplicates
      FROM (SELECT episode_id, count_if(slot <> '' AND value <> '' AND summary_id <> '') AS accepted, count_if(slot = '' OR value = '' OR summary_id = '') AS rejected FROM g GROUP BY ALL) LEFT JOIN a USING (episode_id)""",
    "loaded_turns": _sql("raw", "SELECT reference_id AS episode_id, 0 AS turn_index, coalesce(user_msg, '') AS user_msg, coalesce(agent_msg, '') AS agent_msg FROM raw"),
    "digest_titles": _sql(
        "summaries entries",
        """SELECT index_id, coalesce(string_agg(line, '; ' ORDER BY r), '') AS digest FROM (
          SELECT index_id, row_number() OVER (PARTITION BY index_id ORDER BY m DESC, k, attr) AS r,
            CASE WHEN len(v) > 0 THEN attr || '=' || v[-1] || CASE WHEN len(v) > 1 THEN '[' || array_to_string(v[greatest(len(v) - 3, 1):len(v) - 1], '→') || '→' || v[-1] || ']' ELSE '' END END AS line
          FROM (SELECT a.index_id, a.attr, a.m, a.k, coalesce(b.v, []) AS v FROM
            (SELECT index_id, attr, max(m) AS m, arg_max(k, (m, -k)) AS k FROM e GROUP BY index_id, attr) a
            LEFT JOIN (SELECT index_id, attr, list(value ORDER BY f) AS v FROM (SELECT index_id, attr, value, min((m, k)) AS f FROM e WHERE value <> '' GROUP BY ALL) GROUP BY ALL) b ON b.index_id = a.index_id AND b.attr = a.attr))
        WHERE r <= 6 GROUP BY index_id""",
        """mem AS (SELECT index_id, members[m] AS summary_id, m FROM (SELECT index_id, members, unnest(range(1, len(members) + 1)) AS m FROM entries)),
        key AS (SELECT summary_id, fact_keys[k] AS pair, k FROM (SELECT summary_id, fact_keys, unnest(range(1, len(fact_keys) + 1)) AS k FROM summaries)),
        e AS (SELECT index_id, m, k, trim(split_part(pair, '=', 1)) AS attr, trim(substr(pair, instr(pair, '=') + 1)) AS value FROM mem JOIN key USING (summary_id) WHERE contains(pair, '=') AND trim(split_part(pair, '=', 1)) <> '')""",
    ),
}
_I4 = SQL["i4_extraction"]
SQL["extraction_report"] = f"""SELECT *, coalesce(CAST(round(strict_captured * 10000.0::DOUBLE / nullif(strict_candidates, 0)) AS INTEGER), -1) AS strict_recall,
  coalesce(CAST(round(all_captured * 10000.0::DOUBLE / nullif(all_candidates, 0)) AS INTEGER), -1) AS all_recall FROM ({_I4})"""
SQL["extraction_gaps"] = _sql(
    "raw led",
    f"""SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY turn, reference_id, slot, value) AS INTEGER) AS rank, turn, reference_id, slot, value FROM (
    SELECT f.*, coalesce(list_contains(list_transform(held, lambda h: h <> '' AND x <> '' AND (h = x OR (length(x) >= 2 AND length(h) >= 2 AND (contains(h, x) OR contains(x, h))))), true), false) AS hit
    FROM (SELECT episode_id, turn, reference_id, kind, p.slot AS slot, p.value AS value, {_key('p.value')} AS x FROM (SELECT episode_id, turn, reference_id, kind, unnest(pairs) AS p FROM sig)) f
    LEFT JOIN (SELECT episode_id, observed_turn AS turn, list(DISTINCT {_key('value')}) AS held FROM led WHERE observed_turn IS NOT NULL GROUP BY ALL) h ON h.episode_id = f.episode_id AND h.turn = f.turn)
    WHERE kind = 'change' AND NOT hit QUALIFY rank <= 20""",
    _SIGNALS,
)
SQL["audit_full"] = f"""SELECT r.* EXCLUDE (clean), coalesce(strict_candidates, 0) AS strict_candidates, coalesce(strict_captured, 0) AS strict_captured, coalesce(all_candidates, 0) AS all_candidates, coalesce(all_captured, 0) AS all_captured,
  coalesce(strict_recall, -1) AS strict_recall, true AS i4_ok, clean FROM ({SQL["audit_report"]}) r LEFT JOIN ({SQL["extraction_report"]}) x ON x.episode_id = r.episode_id"""
