"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyweave.llm.conversation_repair import op11_conversation_repair
from tallyweave.llm.decontaminate import op9_decontaminate
from tallyweave.llm.jaccard_join import op5_jaccard_join
from tallyweave.llm.language_id import op3_language_id
from tallyweave.llm.license_scan import op6_license_scan
from tallyweave.llm.matroska import op10_matroska
from tallyweave.llm.mixing import op7_mixing
from tallyweave.llm.period_runs import op12_periodic_runs
from tallyweave.llm.secret_scan import op4_secret_scan
from tallyweave.llm.suffix_dedup import op13_suffix_dedup
from tallyweave.llm.token_orc import op1_token_orc
from tallyweave.llm.url_filter import op2_url_filter
from tallyweave.llm.warc import op8_warc

QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_matroska": op10_matroska,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: Exact for any tables, though op5 compares all pairs that share a shingle: for small ones.
OP5_SQL = r"""WITH RECURSIVE
  w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
  sets AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
  e AS (SELECT node, n, unnest(s) AS e FROM sets),
  links AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.e = b.e AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reach AS (SELECT node, node AS other FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
  low AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
  SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(low.component, s.doc_id) AS component_id FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN low ON low.node = sets.node"""

OP8_SQL = """SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN octet_length(encode(h)) >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN octet_length(encode(h)) >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
  FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)"""

#: The damage's crc32 is worked out bit by bit. Edits are found row by row; the repaired rows' roles follow from their number: after
#: a kept system row, or from the start, user and assistant take turns.
OP11_SQL = r"""WITH RECURSIVE
  c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda z, i: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 20 AS d FROM c),
  damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(CASE d WHEN 3 THEN 2 ELSE 1 END) WHERE d <> 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)),
  f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
  ids AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
  g AS (SELECT id, n, role, text, left(role, 1) AS i, fault FROM f JOIN ids ON f.conv_id IS NOT DISTINCT FROM ids.conv_id),
  told AS (SELECT ids.id, any_value(ids.conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last IS NOT NULL AND left(last, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(n) AS size
    FROM ids LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.id),
  ins(a, b, cost, e) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
  dp AS (SELECT id, 0 AS s, 0::BIGINT AS n, 0::BIGINT AS cost, '' AS audit FROM ids UNION ALL
    SELECT id, s, n, best.c, best.a FROM (
      SELECT dp.id, act.t AS s, g.n, min({'c': dp.cost + ins.cost + act.cost + CASE WHEN g.fault = 'truncated' AND act.e <> 'D' THEN 5 ELSE 0 END, 'a': dp.audit || ins.e || act.e}) AS best
      FROM dp JOIN g ON g.id = dp.id AND g.n = dp.n + 1 JOIN ins ON ins.a = dp.s
      JOIN (VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (3, 'u', 2, 0, 'K'), (0, '', 2, 1, 'R'), (1, '', 2, 1, 'R'), (2, '', 3, 1, 'R'), (3, '', 2, 1, 'R'),
        (0, '', 0, 2, 'D'), (1, '', 1, 2, 'D'), (2, '', 2, 2, 'D'), (3, '', 3, 2, 'D')) AS act(s, i, t, cost, e) ON act.s = ins.b AND (act.e <> 'K' OR act.i = g.i) AND (act.e = 'D' OR g.fault NOT IN ('blank', 'duplicate'))
      GROUP BY dp.id, act.t, g.n)),
  won AS (SELECT id, min({'c': dp.cost + ins.cost, 'a': dp.audit || ins.e}) AS w FROM dp JOIN told USING (id) JOIN ins ON ins.a = dp.s WHERE dp.n = told.size AND ins.b IN (0, 3) GROUP BY id),
  edits AS (SELECT id, j, w.a[j] AS e, len(regexp_replace(w.a[:j], 'I', '', 'g')) AS n FROM (SELECT id, w, unnest(range(1, len(w.a) + 1)) AS j FROM won)),
  made AS (SELECT edits.id, j, e, i, role, text, row_number() OVER (PARTITION BY edits.id ORDER BY j) AS m, first_value(e = 'K' AND i = 's') OVER (PARTITION BY edits.id ORDER BY j) AS led FROM edits LEFT JOIN g ON g.id = edits.id AND g.n = edits.n AND e <> 'I' WHERE e <> 'D'),
  sha AS (SELECT id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS x FROM made GROUP BY id)
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, w.c AS cost, w.a AS audit, coalesce(x, sha256('')) AS repaired_sha256 FROM told JOIN won USING (id) LEFT JOIN sha USING (id)"""

#: Every string of 50 bytes of every document, in hexadecimal.
OP13_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  part AS (SELECT doc_id, b, substr(h, 2 * b + 1, 298) AS p FROM d, LATERAL (SELECT unnest(range(0, len(h) // 2 - 49, 100)) AS b)),
  w AS (SELECT doc_id, b + i AS i, substr(p, 2 * i + 1, 100) AS s FROM part, LATERAL (SELECT unnest(range(least(100, len(p) // 2 - 49))) AS i)),
  gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
  runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CASE WHEN i - last <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM gone)) GROUP BY doc_id, run),
  kept AS (SELECT doc_id, h, unnest(list_zip([0] || coalesce(ends, []), coalesce(begins, []) || [len(h) // 2])) AS p, coalesce(removed, 0) AS n_removed, coalesce(len(ends), 0) AS n_spans
    FROM d LEFT JOIN (SELECT doc_id, list(a ORDER BY a) AS begins, list(b ORDER BY a) AS ends, sum(b - a) AS removed FROM runs GROUP BY doc_id) USING (doc_id))
  SELECT doc_id, len(any_value(h)) // 2 AS n_bytes, any_value(n_removed)::BIGINT AS n_removed, any_value(n_spans) AS n_spans, sha256(unhex(string_agg(substr(h, 2 * p[1] + 1, 2 * (p[2] - p[1])), '' ORDER BY p[1]))) AS kept_sha256 FROM kept GROUP BY doc_id"""

ORACLE_SQL = {"op5_jaccard_join": OP5_SQL, "op8_warc": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_suffix_dedup": OP13_SQL}
