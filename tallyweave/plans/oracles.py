"""DuckDB SQL for the queries, over the same tables. Amounts are whole cents as BIGINT until they are shown."""

from __future__ import annotations

from tallyweave.functions.text import glyphs
from tallyweave.sources.dims import CATEGORIES, CATEGORY_PREFIX, RULES, aliases

Q = chr(39)


def text(s: str) -> str:
    return Q + s.replace(Q, Q * 2) + Q


def listed(xs) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]"


EXPENSES = f"""
cents AS (SELECT *, CAST(floor(o_totalprice / 100 * 100 + 0.5) AS BIGINT) AS c FROM orders),
expenses AS (
  SELECT o_orderkey AS id, o_custkey AS batch_id,
    CASE WHEN o_orderkey % 13 <> 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN upper(n_name) ELSE n_name END) || ' ' END AS vendor,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
    CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE c END AS amount_cents,
    CAST(floor(c / 20.0::DOUBLE) AS BIGINT) AS tax_cents,
    {listed(CATEGORIES)}[o_orderkey % 12 + 1] AS category,
    CASE WHEN o_orderkey % 19 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'processing' END AS status,
    o_orderkey % 3 = 0 AS review_required, o_orderkey % 9 = 0 AS approved,
    ['USD', 'EUR', 'GBP', 'JPY', 'CAD'][n_regionkey + 1] AS currency,
    (o_orderkey % 101)::DOUBLE / 100.0::DOUBLE AS confidence, o_orderkey AS created_at
  FROM cents JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
reported AS (SELECT * FROM expenses WHERE status <> 'failed' AND amount_cents > 0)
"""
PLACE = f"CAST(list_position({listed(CATEGORIES)}, category) AS INTEGER)"


def units(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) / 100.0::DOUBLE)"


def fixed(c: str) -> str:
    """1234.50 of cents."""
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def q(body: str, *more: str) -> str:
    return "WITH " + ",".join([EXPENSES, *more]) + body


DAYS = "days AS (SELECT day, count(*) AS n, sum(amount_cents)::BIGINT AS c FROM reported WHERE day IS NOT NULL GROUP BY day)"
SHORT = "CASE WHEN {c} >= 100000 THEN '$' || CAST(CAST(floor({c} / 100.0::DOUBLE / 100 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR) || 'k' ELSE '$' || CAST(CAST(floor({c} / 100.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) END"
DISPLAY = "CASE WHEN category = 'Other' THEN 'Miscellaneous' ELSE category END"
PREFIX = "CASE category " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in CATEGORY_PREFIX.items()) + " END"
NAMED = f"""named AS (SELECT *, {PREFIX} || '_' || strftime(day, '%m-%d-%y') || CASE WHEN vendor IS NULL THEN '' ELSE '_' || regexp_replace(lower(trim(vendor)), '[\\s-]+', '_', 'g') END AS stem FROM expenses WHERE day IS NOT NULL)"""
N_ALIASES = len(aliases())
ALIAS_ROWS = ", ".join(f"({text(n)}, {text(c)}, {text(a)}, {k})" for k, (n, c, a, _) in enumerate(aliases()))


def word(alias: str) -> str:
    import re

    return f"(^|[^a-z0-9]){re.escape(alias)}([^a-z0-9]|$)"


ALIAS_TABLE = "alias(name, category, alias, pattern) AS (VALUES " + ", ".join(f"({text(n)}, {text(c)}, {text(a)}, {text(word(a))})" for n, c, a, _ in aliases()) + ")"
NOTES = f"""notes AS (SELECT p_partkey, 'no ' || CAST(p_partkey AS VARCHAR) || ' / ' || CASE p_partkey % 3 WHEN 0 THEN upper(a) WHEN 1 THEN a || 'x' ELSE a END || ', thanks' AS note
  FROM (SELECT p_partkey, {listed(a for _, _, a, _ in aliases())}[p_partkey % {N_ALIASES} + 1] AS a FROM part))"""
KEYWORDS = [k for _, ks in RULES for k in ks]
RULE_CASES = " ".join("WHEN " + " OR ".join(f"regexp_matches(shown, {text(word(k))})" for k in ks) + f" THEN {text(c)}" for c, ks in RULES)
MERGE_SIDE = "SELECT p_partkey AS id, p_name || ' v{k}' AS name, p_partkey * {m} % 100 AS updated_at FROM part WHERE p_partkey % 3 <> {k}"
CHANGES = ", ".join(f"{{'field': {text(f)}, 'old': coalesce({o}, ''), 'new': coalesce({n}, '')}}" for f, o, n in (("vendor", "vendor", "CASE WHEN id % 5 = 0 THEN 'Shell' ELSE vendor END"), ("category", "category", "CASE WHEN id % 7 = 0 THEN 'Fuel' ELSE category END")))
FIRST = """SELECT id, first AS duplicate_of FROM (SELECT id, first_value(id) OVER (PARTITION BY {keys} ORDER BY created_at, id) AS first FROM keyed WHERE {some}) WHERE first <> id"""
BRANDS = """brand AS (SELECT min(vec_id) AS vec_id, label FROM embeddings GROUP BY label),
scored AS (SELECT e.vec_id, b.vec_id AS brand, floor(greatest(-1.0, least(1.0, list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]))) * 1e4 + 0.5) / 1e4 AS score
  FROM embeddings e, brand b JOIN embeddings v ON v.vec_id = b.vec_id WHERE e.vec_id NOT IN (SELECT vec_id FROM brand)),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, brand) AS INTEGER) AS place FROM scored)"""
RECEIPTS = """receipts AS (SELECT o_orderkey AS receipt, o_orderkey % 5 AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS day, CAST(floor(o_totalprice / 100 * 100 + 0.5) AS BIGINT) AS c FROM orders)"""


def folded(alias: str) -> str:
    return glyphs(alias).translate(str.maketrans("0158", "olsb")).replace(" ", "")


NAMES = [a for _, _, a, slogan in aliases() if not slogan]
FOLDED = sorted({folded(a) for a in NAMES if len(a) >= 5 and len(folded(a)) >= 5})
FOLD = "replace(translate(trim(regexp_replace(replace(replace(replace(replace(lower({x}), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'u', 'v'), '[^a-z0-9]+', ' ', 'g')), '0158', 'olsb'), ' ', '')"
FUZZY = f"""WITH p AS (SELECT p_partkey, {listed(NAMES)}[p_partkey % {len(NAMES)} + 1] AS a FROM part),
  line AS (SELECT p_partkey, upper(substr(a, 1, p_partkey % length(a)) || 'x' || substr(a, p_partkey % length(a) + 2)) AS line FROM p),
  w AS (SELECT *, string_split_regex(trim(line), '\\s+') AS w FROM line),
  part AS (SELECT p_partkey, unnest(list_filter([line, CASE WHEN length(w[1]) >= 4 THEN w[1] END, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END], lambda x: x IS NOT NULL)) AS x FROM w),
  c AS (SELECT p_partkey, {FOLD.format(x="x")} AS c FROM part),
  f AS (SELECT unnest({listed(FOLDED)}) AS f),
  met AS (SELECT p_partkey, length(f) AS l, levenshtein(c, f) AS d FROM c JOIN f ON abs(length(c) - length(f)) <= 2 AND length(c) >= 5)
  SELECT p_partkey, CAST(floor((1 - d / l::DOUBLE) * 1e6::DOUBLE + 0.5) AS BIGINT) AS ratio FROM met WHERE d <= CASE WHEN l <= 6 THEN 1 ELSE 2 END
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, l DESC) = 1"""


KNOWN = [(k, n, c, a) for k, (n, c, a, slogan) in enumerate(aliases()) if len(a) >= 5 and not slogan]
KNOWN_ROWS = ", ".join(f"({k}, {text(n)}, {text(c)}, {text(folded(a))})" for k, n, c, a in KNOWN if len(folded(a)) >= 5)
#: The whole table of the longest common subsequence, a row for each letter of c.
LCS = """list_last(list_reduce([list_transform(range(length(f) + 1), lambda z: 0::BIGINT)] || list_transform(string_split(c, ''), lambda z: [ord(z)::BIGINT]),
    lambda prior, letter: list_reduce([[0::BIGINT]] || list_transform(range(1, length(f) + 1), lambda j: [CASE WHEN ord(f[j]) = letter[1] THEN prior[j] + 1 ELSE prior[j + 1] END]), lambda row, v: row || [greatest(list_last(row), v[1])])))"""
FUZZY_NAMES = f"""WITH known(place, name, category, f) AS (VALUES {KNOWN_ROWS}),
  p AS (SELECT p_partkey, {listed(a for _, _, a, _ in aliases())}[p_partkey % {N_ALIASES} + 1] AS a, p_partkey // {N_ALIASES} % 4 AS kind FROM part),
  m AS (SELECT *, p_partkey % length(a) + 1 AS pos FROM p),
  s AS (SELECT p_partkey, substr(a, 1, pos - 1) || CASE kind WHEN 0 THEN '' WHEN 1 THEN a[pos] || a[pos] WHEN 2 THEN 'z' ELSE a[pos] || 'q' END || substr(a, pos + 1) AS shown FROM m),
  v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN shown || ' no ' || p_partkey ELSE upper(shown) END AS vendor FROM s),
  c AS (SELECT p_partkey, {FOLD.format(x="vendor")} AS c FROM v WHERE length(trim(vendor)) <= 40 AND len(string_split_regex(trim(vendor), '\\s+')) <= 6),
  r AS (SELECT *, 2 * {LCS} / (length(c) + length(f))::DOUBLE AS r FROM c JOIN known ON length(c) >= 5 AND abs(length(c) - length(f)) <= 3)
  SELECT p_partkey, name, category, CAST(floor(r * 1e6::DOUBLE + 0.5) AS BIGINT) AS ratio, r >= 0.93 AS renamed FROM r WHERE r >= 0.88 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY r DESC, length(f) DESC, place) = 1"""
LOGOS = """SELECT e.vec_id, b.vec_id AS brand, floor(greatest(-1.0, least(1.0, list_dot_product(e.embedding::DOUBLE[], b.embedding::DOUBLE[]))) * 1e4 + 0.5) / 1e4 AS score, score >= 0.78 AS accepted
  FROM embeddings e JOIN embeddings b ON e.vec_id % 2 = 1 AND b.vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY score DESC, b.vec_id) = 1"""


#: Every pixel reaches every pixel of its region; the least names it.
REGIONS = """WITH RECURSIVE px AS (SELECT vec_id, i, greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[i + 1]::DOUBLE * 3.0::DOUBLE + 0.55::DOUBLE)) AS p FROM embeddings, range(64) t(i)),
  lit AS (SELECT * FROM px WHERE p > 0.3::DOUBLE),
  reach AS (SELECT vec_id, i, i AS root FROM lit UNION SELECT r.vec_id, o.i, r.root FROM reach r JOIN lit o ON o.vec_id = r.vec_id AND ((o.i // 8 = r.i // 8 AND abs(o.i - r.i) = 1) OR abs(o.i - r.i) = 8)),
  named AS (SELECT vec_id, i, min(root) AS root FROM reach GROUP BY vec_id, i),
  box AS (SELECT vec_id, root, min(i % 8) AS a, min(i // 8) AS b, max(i % 8) AS c, max(i // 8) AS d, avg(p) AS score FROM named JOIN lit USING (vec_id, i) GROUP BY vec_id, root),
  good AS (SELECT *, CAST(floor((c - a + 1) * 0.3::DOUBLE + 0.5) AS INTEGER) AS px, CAST(floor((d - b + 1) * 0.3::DOUBLE + 0.5) AS INTEGER) AS py FROM box WHERE c - a >= 2 AND d - b >= 2 AND score >= 0.5)
  SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) - 1 AS INTEGER) AS box, CAST(greatest(0, a - px) AS INTEGER) AS x0, CAST(greatest(0, b - py) AS INTEGER) AS y0, CAST(least(7, c + px) AS INTEGER) AS x1, CAST(least(7, d + py) AS INTEGER) AS y1,
    CAST(floor(score * 1e6::DOUBLE + 0.5) AS BIGINT) AS score FROM good"""
CROPS = """WITH g AS (SELECT vec_id, i, i % 16 AS x, i // 16 AS y, CASE WHEN (i % 16 = 0 AND vec_id % 3 = 0) OR (i // 16 = 15 AND vec_id % 4 = 0) THEN 0.0 WHEN i % 16 > vec_id % 12 + 4 AND vec_id % 2 = 0 THEN 255.0
      ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[i // 32 * 8 + i % 16 // 2 + 1]::DOUBLE * 2 + 0.5::DOUBLE)) * 255) END::DOUBLE AS v FROM embeddings, range(256) t(i)),
  l AS (SELECT vec_id, list(v ORDER BY i) AS v FROM g GROUP BY vec_id),
  e AS (SELECT vec_id, x, y, CASE WHEN x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 THEN abs(l.v[i + 2] - l.v[i]) + abs(l.v[i + 17] - l.v[i - 15]) ELSE 0 END AS e FROM g JOIN l USING (vec_id)),
  r AS (SELECT vec_id, y, sum(e) AS s, max(sum(e)) OVER (PARTITION BY vec_id) AS m FROM e GROUP BY vec_id, y), c AS (SELECT vec_id, x, sum(e) AS s, max(sum(e)) OVER (PARTITION BY vec_id) AS m FROM e GROUP BY vec_id, x),
  rows_ AS (SELECT vec_id, min(y) AS y0, max(y) AS y1 FROM r WHERE s >= m * 0.06::DOUBLE GROUP BY vec_id), columns_ AS (SELECT vec_id, min(x) AS x0, max(x) AS x1 FROM c WHERE s >= m * 0.06::DOUBLE GROUP BY vec_id),
  d AS (SELECT vec_id, CAST(count(*) FILTER (x = 0 AND v < 80) >= 0.3 * 16 AS INTEGER) AS "left", CAST(count(*) FILTER (y = 0 AND v < 80) >= 0.3 * 16 AS INTEGER) AS top, CAST(count(*) FILTER (x = 15 AND v < 80) >= 0.3 * 16 AS INTEGER) AS "right", CAST(count(*) FILTER (y = 15 AND v < 80) >= 0.3 * 16 AS INTEGER) AS bottom FROM g GROUP BY vec_id),
  b AS (SELECT *, greatest(x0, "left") AS cx, greatest(y0, top) AS cy, greatest(1, least(x1 + 1, 16 - "right") - greatest(x0, "left")) AS cw, greatest(1, least(y1 + 1, 16 - bottom) - greatest(y0, top)) AS ch FROM d JOIN rows_ USING (vec_id) JOIN columns_ USING (vec_id)),
  k AS (SELECT *, cw * ch > 0.45 * 256 AND cw > 6.4 AND ch > 6.4 AS good FROM b)
  SELECT vec_id, "left", top, "right", bottom, CAST(x0 AS INTEGER) AS x, CAST(y0 AS INTEGER) AS y, CAST(x1 - x0 + 1 AS INTEGER) AS w, CAST(y1 - y0 + 1 AS INTEGER) AS h,
    CAST(floor(CASE WHEN good THEN greatest(0, cx - cw * 0.02::DOUBLE) ELSE "left" END * 1e4::DOUBLE + 0.5) AS BIGINT) AS crop_x, CAST(floor(CASE WHEN good THEN greatest(0, cy - ch * 0.02::DOUBLE) ELSE top END * 1e4::DOUBLE + 0.5) AS BIGINT) AS crop_y,
    CAST(floor(CASE WHEN good THEN least(16, cw * 1.04::DOUBLE) ELSE 16 - "left" - "right" END * 1e4::DOUBLE + 0.5) AS BIGINT) AS crop_w, CAST(floor(CASE WHEN good THEN least(16, ch * 1.04::DOUBLE) ELSE 16 - top - bottom END * 1e4::DOUBLE + 0.5) AS BIGINT) AS crop_h FROM k"""


LOCATED = f"""WITH r AS (SELECT o_orderkey AS receipt, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS day, CAST(floor(o_totalprice / 100 * 100 + 0.5) AS BIGINT) AS c FROM orders),
  t AS (SELECT *, CAST(floor(c / 20.0::DOUBLE) AS BIGINT) AS tax, ['thank you for the visit', 'store copy', 'please come again'][:k % 4] AS filler, CASE WHEN k % 3 = 0 THEN ['visa'] ELSE [] END AS paid FROM r),
  l AS (SELECT receipt, unnest(range(len(names))) AS line_no, unnest(names) AS name, unnest(cents) AS cents, unnest(days) AS day FROM (
    SELECT receipt, filler || paid || [['shell 0042', 'home depot 4', 'joe''s diner', 'marriott downtown', 'at the seaside inn'][k % 5 + 1], 'date', 'subtotal', 'tax', 'total'] AS names,
      list_transform(filler, lambda x: NULL::BIGINT) || list_transform(paid, lambda x: c) || [NULL, NULL, c - tax, tax, c] AS cents,
      list_transform(filler || paid, lambda x: NULL::DATE) || [NULL, day, NULL, NULL, NULL] AS days FROM t)),
  w AS (SELECT receipt, c * 10 + [0, 4, -5, 5, 9, -6][k % 6 + 1] AS mils, ['shell oil', 'the home depot', 'joe''s diner', 'marriott', 'seaside inn'][k % 5 + 1] AS vendor, CASE WHEN k % 7 = 0 THEN day + 1 ELSE day END AS day FROM r),
  met AS (SELECT receipt, 'amount' AS kind, CASE WHEN name = 'visa' THEN 1 ELSE 0 END AS rank, line_no FROM l JOIN w USING (receipt) WHERE mils > 0 AND abs(10 * cents - mils) <= 5
    UNION ALL SELECT receipt, 'vendor', p, line_no FROM l JOIN (SELECT receipt, p, CASE p WHEN 0 THEN vendor ELSE split_part(vendor, ' ', 1) END AS probe FROM w, range(2) x(p)) USING (receipt) WHERE contains(name, probe)
    UNION ALL SELECT receipt, 'date', 0, line_no FROM l JOIN w USING (receipt, day))
  SELECT receipt, kind, CAST(arg_min(line_no, (rank, line_no)) AS INTEGER) AS line_no FROM met GROUP BY receipt, kind"""
#: The log of a user as one list; the lists left after each edit.
FOLDED_LOG = """SELECT "user", e.seq AS seq, e.receipt AS receipt, e.field AS field, e.old AS old, e.new AS new FROM (SELECT "user", unnest(list_reduce(es, lambda s, e:
    CASE WHEN len(s) = 0 OR list_last(s).receipt <> e[1].receipt OR list_last(s).field <> e[1].field OR list_last(s).new <> e[1].old THEN s || e
      WHEN list_last(s).old = e[1].new THEN s[:len(s) - 1] ELSE s[:len(s) - 1] || [{'seq': e[1].seq, 'receipt': e[1].receipt, 'field': e[1].field, 'old': list_last(s).old, 'new': e[1].new}] END)[-2000:]) AS e
  FROM (SELECT user_id AS "user", list([{'seq': event_id, 'receipt': CAST(event_id % 2 AS VARCHAR), 'field': event_type, 'old': CAST(event_id % 3 AS VARCHAR), 'new': CAST((event_id + 1) % 3 AS VARCHAR)}] ORDER BY event_id) AS es FROM events GROUP BY user_id))"""


VISION = """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 100 * 100 + 0.5) AS BIGINT) AS c, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS d FROM orders WHERE o_orderkey % 11 > 1),
  f AS (SELECT k, ['Shell', 'Corner Bakery', NULL, 'Zxq', 'Chevron 12'][k % 5 + 1] AS vendor, CASE WHEN k % 3 = 0 THEN d END AS day, CASE WHEN k % 6 IN (0, 1, 4) AND c <= 100000000 THEN c ELSE 0 END AS amount_cents, [125, 250][k % 2 + 1]::BIGINT AS tax_cents,
    CASE WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN k % 4 > 0 AND k % 3 = 0 THEN 'Meals' ELSE ['Fuel', 'Meals', NULL, NULL, 'Fuel'][k % 5 + 1] END AS found FROM o),
  g AS (SELECT *, list_filter([CASE WHEN amount_cents <= 0 THEN 'no_amount:error' END, CASE WHEN day IS NULL THEN 'no_date:warn' END, CASE WHEN vendor IS NULL THEN 'no_vendor:warn' END, CASE WHEN found IS NULL THEN 'uncategorized:info' END,
    CASE WHEN amount_cents > 100000 THEN 'large_amount:info' END, CASE WHEN day > DATE '2012-01-02' THEN 'future_date:warn' END, CASE WHEN DATE '2012-01-01' - day > 120 THEN 'stale_date:info' END], lambda x: x IS NOT NULL) AS flags FROM f),
  n AS (SELECT *, round(greatest(0, 0.92::DOUBLE - (CASE WHEN amount_cents <= 0 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN day IS NULL THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN vendor IS NULL THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN day > DATE '2012-01-02' THEN 0.07::DOUBLE ELSE 0 END)), 9) AS confidence FROM g)
  SELECT k AS o_orderkey, vendor, day, amount_cents, tax_cents, currency, coalesce(found, 'Other') AS category, confidence, array_to_string(CASE WHEN confidence < 0.8 THEN flags || ['low_confidence:info'] ELSE flags END, ';') AS flags, confidence < 0.8 OR amount_cents <= 0 AS review FROM n"""


BOARD = ", ".join(f"CAST(row_number() OVER (PARTITION BY batch_id ORDER BY {o}created_at DESC, id DESC) AS INTEGER) AS {n}" for n, o in (("newest", ""), ("by_date", "day DESC NULLS LAST, "), ("by_amount", "amount_cents DESC, "), ("by_vendor", "lower(trim(vendor)) NULLS LAST, "), ("by_category", "lower(category), ")))
SCANS = """scans AS (SELECT id, batch_id, vendor, day, amount_cents AS c, created_at AS at_, id::VARCHAR AS image FROM expenses UNION ALL SELECT id + 10000000000, batch_id, vendor, day, amount_cents, created_at + 10000000000, id::VARCHAR FROM expenses WHERE id % 11 = 0
    UNION ALL SELECT id + 20000000000, batch_id, lower(vendor), day, amount_cents, created_at + 20000000000, 'new ' || id FROM expenses WHERE id % 7 = 0),
  firsts AS (SELECT id, first_value(id) OVER (PARTITION BY batch_id, image ORDER BY at_, id) AS i, CASE WHEN c > 0 THEN first_value(id) OVER (PARTITION BY batch_id, lower(trim(coalesce(vendor, ''))), day, c ORDER BY at_, id) END AS d FROM scans)"""


ROUTED = """scans AS (SELECT id, batch_id, vendor, day, amount_cents AS c, confidence, created_at AS at_, id::VARCHAR AS image FROM expenses
    UNION ALL SELECT id + 10000000000, batch_id, upper(vendor), day, amount_cents, confidence, created_at + 10000000000, CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE 'new ' || id END FROM expenses WHERE id % 7 = 0),
  firsts AS (SELECT *, first_value(id) OVER (PARTITION BY batch_id, image ORDER BY at_, id) AS i, CASE WHEN c > 0 THEN first_value(id) OVER (PARTITION BY batch_id, lower(trim(coalesce(vendor, ''))), day, c ORDER BY at_, id) ELSE id END AS d FROM scans)"""
ROUTES = """SELECT id, array_to_string(list_filter([CASE WHEN i = id AND d <> id THEN 'duplicate:warn' END, CASE WHEN c <= 0 THEN 'no_amount:error' END, CASE WHEN vendor IS NULL THEN 'no_vendor:warn' END, CASE WHEN id % 23 = 0 THEN 'total_suspect:warn' END,
    CASE WHEN id % 31 = 0 THEN 'vendor_unclear:warn' END, CASE WHEN id % 5 = 0 THEN 'total_mismatch:info' END], lambda x: x IS NOT NULL), ';') AS flags,
  i <> id OR d <> id OR c <= 0 OR id % 23 = 0 OR id % 31 = 0 OR confidence < 0.8::DOUBLE AS review, c <= 0 OR confidence < 0.8::DOUBLE AS assist FROM firsts"""
RESCUED = """WITH r AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 100 * 100 + 0.5) AS BIGINT) * 10 AS m FROM orders),
  t AS (SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE m END AS a, CASE WHEN id % 4 = 0 THEN 0 ELSE m + [0, 4, 5, -4, 1000][id % 5 + 1] END AS b, id % 50 AS ca, id % 37 AS cb FROM r),
  s AS (SELECT *, id % 13 <> 0 AND id % 11 <> 0 AND (id % 100 < 65 OR a <= 0) AND ((b > 0 AND a <= 0) OR (abs(a - b) < 5 AND cb > ca)) AS swapped FROM t)
  SELECT id, CASE WHEN swapped THEN 'second' ELSE 'first' END AS vendor, CASE WHEN swapped THEN b ELSE a END AS mils, CASE WHEN swapped THEN cb ELSE ca END / 100.0::DOUBLE AS confidence, CASE WHEN swapped THEN 80 ELSE id % 100 END::DOUBLE AS page_conf, swapped FROM s"""
COSTS = """SELECT event_id, CAST(floor((CASE WHEN event_id % 6 > 0 THEN event_id % 3000 ELSE 0 END / 1e6::DOUBLE * coalesce(p_size, 0)::DOUBLE + (event_id % 700) / 1e6::DOUBLE * (coalesce(p_size, 0) * 5)::DOUBLE) * 1e9::DOUBLE + 0.5) AS BIGINT) AS nanos FROM events LEFT JOIN part ON p_partkey = event_id % 400 + 1"""
#: Where each style of line has its rightmost money: by its words' boxes, or by characters of a line half as wide as the page.
WORDS = """WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 5 AS k, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c FROM lineitem),
  n AS (SELECT *, length(CAST(c // 100 AS VARCHAR)) + 3 AS la, length(CAST((c + 100) // 100 AS VARCHAR)) + 3 AS lb, length(CAST(l_orderkey AS VARCHAR)) AS lk FROM l),
  h AS (SELECT l_orderkey, l_linenumber, CASE WHEN k IN (1, 2) THEN c + 100 WHEN k = 4 THEN l_orderkey * 100 ELSE c END AS cents,
    CASE k WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.25::DOUBLE + 0.5::DOUBLE * (la + 3) / (la + 3 + lb) WHEN 3 THEN 0.25::DOUBLE + 0.5::DOUBLE * 4 / (la + 5) ELSE 0.25::DOUBLE + 0.5::DOUBLE * 10 / (lk + 11) END AS x, CASE WHEN k < 2 THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS y,
    CASE k WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.5::DOUBLE * lb / (la + 3 + lb) WHEN 3 THEN 0.5::DOUBLE * la / (la + 5) ELSE 0.5::DOUBLE * (lk + 1) / (lk + 11) END AS w FROM n)
  SELECT l_orderkey, l_linenumber, CAST(cents AS BIGINT) AS cents, CAST(floor(x * 1e6::DOUBLE + 0.5) AS BIGINT) AS x, CAST(floor(y * 1e6::DOUBLE + 0.5) AS BIGINT) AS y, CAST(floor(w * 1e6::DOUBLE + 0.5) AS BIGINT) AS w FROM h"""
INTAKE = """WITH f AS (SELECT l_suppkey AS batch_id, l_orderkey * 10 + l_linenumber AS file_id, 'a ' || l_orderkey || ['.jpg', '.PNG', '', '.txt', '.pdf'][(l_orderkey + l_linenumber) % 5 + 1] AS name, l_orderkey % 1000 AS at_,
    CASE WHEN l_orderkey % 4 <> 1 AND (l_orderkey + l_linenumber) % 5 IN (2, 3) THEN 'type' WHEN l_orderkey % 17 = 0 THEN 'empty' WHEN floor(l_extendedprice * 400) > 26214400 THEN 'size' END AS no FROM lineitem),
  p AS (SELECT *, count(*) FILTER (no IS NULL) OVER (PARTITION BY batch_id ORDER BY at_, file_id) + CASE WHEN batch_id % 2 = 0 THEN batch_id * 10 ELSE 0 END AS place FROM f)
  SELECT batch_id, file_id, name, CASE WHEN no IS NULL AND place > 200 THEN 'full' ELSE no END AS refused FROM p"""
REPORT = f"""SELECT {DISPLAY} AS category, coalesce(CAST(day AS VARCHAR), '') AS "date", coalesce(CASE id % 4 WHEN 0 THEN 'a "b", ' || vendor WHEN 1 THEN 'two' || chr(10) || 'lines ' || vendor ELSE vendor END, '') AS vendor, {fixed('amount_cents')} AS amount, currency,
  CAST(CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS VARCHAR) AS confidence, CASE WHEN review_required AND NOT approved THEN 'Needs review' WHEN approved THEN 'Approved' ELSE 'OK' END AS status, CASE WHEN review_required AND NOT approved THEN 'Low confidence — please review.' ELSE '' END AS notes FROM reported"""


def oracle_sql() -> dict[str, str]:
    return {
        "review_routing": q(ROUTES, ROUTED),
        "rescue_reads": RESCUED,
        "model_costs": COSTS,
        "word_amounts": WORDS,
        "file_intake": INTAKE,
        "report_file": q(REPORT),
        "board_sorts": q(f"SELECT batch_id, id, {BOARD} FROM expenses"),
        "receipt_duplicates": q("SELECT id, CASE WHEN i <> id THEN i ELSE d END AS duplicate_of, CASE WHEN i <> id THEN 'image' ELSE 'details' END AS via FROM firsts WHERE i <> id OR d <> id", SCANS),
        "saved_jobs": """WITH j AS (SELECT s_suppkey AS k, upper(s_name) AS name, CASE s_suppkey % 3 WHEN 1 THEN 'k- ' || (s_suppkey + 1) ELSE 'j-' || s_suppkey END AS number, CASE WHEN s_suppkey % 3 = 1 THEN 1000000000 ELSE 0 END + s_suppkey AS saved FROM supplier WHERE s_suppkey % 3 > 0)
            SELECT s_suppkey, (SELECT arg_max(name, saved) FROM j WHERE j.number = CASE WHEN s_suppkey % 2 = 0 THEN 'j-' || s_suppkey ELSE 'k- ' || (s_suppkey + 1) END) AS name FROM supplier""",
        "vision_fields": VISION,
        "locate_values": LOCATED,
        "correction_fold": FOLDED_LOG,
        "stream_correction_fold": FOLDED_LOG,
        "lcs_ratios": f"SELECT p_partkey, 2.0::DOUBLE * {LCS} / (length(c) + length(f)) AS ratio FROM (SELECT p_partkey, p_name AS c, p_type AS f FROM part)",
        "text_regions": REGIONS,
        "content_crops": CROPS,
        "fuzzy_names": FUZZY_NAMES,
        "logo_matches": LOGOS,
        "fuzzy_header": FUZZY,
        "upload_ranges": "SELECT o_orderkey, a AS start, least(a + step, size) - 1 AS stop FROM (SELECT o_orderkey, size, step, unnest(generate_series(0, size - 1, step)) AS a FROM (SELECT o_orderkey, (o_orderkey + 1) * 10007 AS size, CASE WHEN (o_orderkey + 1) * 10007 <= 4194304 THEN (o_orderkey + 1) * 10007 ELSE 5242880 END AS step FROM orders))",
        "spend_by_category": q(f"SELECT category, count(*) AS n, {units('sum(amount_cents)')} AS total, {PLACE} AS place FROM reported GROUP BY category"),
        "headline_kpis": q(f"SELECT count(*) AS n, {units('sum(amount_cents)')} AS total, {units('sum(tax_cents)')} AS tax, {units('floor(sum(amount_cents)::DOUBLE / count(*) + 0.5)')} AS average, {units('max(amount_cents)')} AS largest, count(*) FILTER (review_required AND NOT approved) AS flagged, count(DISTINCT category) AS categories FROM reported"),
        "top_vendors": q(f"""SELECT CAST(row_number() OVER (ORDER BY c DESC, n DESC, vendor) AS INTEGER) AS place, vendor, n, {units('c')} AS total FROM (
            SELECT arg_min(name, id) AS vendor, count(*) AS n, sum(amount_cents) AS c FROM (SELECT *, coalesce(nullif(trim(vendor), ''), '—') AS name FROM reported) GROUP BY lower(name)) ORDER BY c DESC, n DESC, vendor LIMIT 5"""),
        "spend_timeline": q(f"SELECT day, n, {units('c')} AS total FROM days", DAYS),
        "cumulative_spend": q(f"SELECT day, {units('sum(c) OVER (ORDER BY day)')} AS so_far FROM days", DAYS),
        "report_period": q("SELECT strftime(min(day), '%b %-d, %Y') || ' – ' || strftime(max(day), '%b %-d, %Y') AS period FROM days", DAYS),
        "chart_buckets": q(f"SELECT CAST(date_trunc('month', day) AS DATE) AS start, strftime(date_trunc('month', day), '%b ''%y') AS label, {units('sum(c)')} AS total, {SHORT.format(c='sum(c)')} AS value_label FROM days GROUP BY ALL", DAYS),
        "category_share": q(f"SELECT category, CAST(floor(c * 100.0::DOUBLE / sum(c) OVER () + 0.5) AS BIGINT) AS percent FROM (SELECT category, sum(amount_cents)::BIGINT AS c FROM reported GROUP BY category ORDER BY c DESC, {PLACE} LIMIT 7)"),
        "dominant_currency": q("SELECT category, currency FROM (SELECT category, currency, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, min(id)) AS r FROM reported GROUP BY category, currency) WHERE r = 1"),
        "summary_rollup": q(f"SELECT label, {units('c')} AS total FROM (SELECT {DISPLAY} AS label, sum(amount_cents) AS c FROM reported GROUP BY category UNION ALL SELECT 'TOTAL', sum(amount_cents) + 37500 + 12600 FROM reported UNION ALL VALUES ('Per diem', 37500), ('Phone service', 12600))"),
        "summary_lines": q(f"SELECT batch_id, {PLACE} AS section, category, CAST(row_number() OVER (PARTITION BY batch_id, category ORDER BY day NULLS FIRST, id) AS INTEGER) AS line, id, day, {units('amount_cents')} AS amount FROM reported"),
        "csv_rows": q(f"SELECT id, concat_ws(',', {DISPLAY}, coalesce(CAST(day AS VARCHAR), ''), coalesce(vendor, ''), {fixed('amount_cents')}, currency, CAST(CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS VARCHAR), CASE WHEN review_required AND NOT approved THEN 'Needs review' WHEN approved THEN 'Approved' ELSE 'OK' END, CASE WHEN review_required AND NOT approved THEN 'Low confidence — please review.' ELSE '' END) AS line FROM reported"),
        "sheet_rows": q("SELECT id, CAST(4 * (row_number() OVER (PARTITION BY batch_id, category ORDER BY id) - 1) + 3 AS BIGINT) AS sheet_row FROM reported"),
        "status_counts": q("SELECT s.status, count(e.id) AS n FROM (VALUES ('queued'), ('processing'), ('needs_review'), ('done'), ('failed')) s(status) LEFT JOIN expenses e ON e.status = s.status GROUP BY s.status"),
        "board_lanes": q("SELECT CASE WHEN status = 'processing' THEN 'working' WHEN status = 'needs_review' THEN 'review' ELSE status END AS lane, count(*) AS n FROM expenses GROUP BY 1"),
        "board_order": q("SELECT batch_id, id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY lower(trim(vendor)) NULLS LAST, id DESC) AS INTEGER) AS place FROM expenses"),
        "next_open": q("SELECT e.batch_id, e.id, coalesce(min(o.id) FILTER (o.id > e.id), min(o.id)) AS next_open FROM expenses e LEFT JOIN expenses o ON o.batch_id = e.batch_id AND o.review_required AND NOT o.approved GROUP BY e.batch_id, e.id"),
        "within_budget": q("SELECT id, sum(amount_cents) OVER (PARTITION BY batch_id ORDER BY id) <= 1000000 AS fits FROM expenses"),
        "needs_review": q("SELECT id, confidence < 0.8::DOUBLE OR amount_cents <= 0 AS review FROM expenses"),
        "chart_labels": q(f"SELECT id, {SHORT.format(c='amount_cents')} AS short, '$' || format('{{:,}}', amount_cents // 100) || '.' || lpad(CAST(amount_cents % 100 AS VARCHAR), 2, '0') AS \"full\", left({DISPLAY}, 31) AS sheet FROM expenses"),
        "exact_duplicates": q(FIRST.format(keys="batch_id, k", some="true"), "keyed AS (SELECT *, batch_id || '|' || coalesce(strftime(day, '%Y-%m'), '') AS k FROM expenses)"),
        "semantic_duplicates": q(FIRST.format(keys="k", some="true"), "keyed AS (SELECT *, concat_ws('|', lower(trim(coalesce(vendor, ''))), coalesce(strftime(day, '%Y-%m'), ''), amount_cents // 100000) AS k FROM expenses)"),
        "lww_merge": f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.updated_at > a.updated_at THEN b.name ELSE a.name END AS name, CASE WHEN a.id IS NULL OR b.updated_at > a.updated_at THEN b.updated_at ELSE a.updated_at END AS updated_at, coalesce(a.id IS NULL OR b.updated_at > a.updated_at, false) AS from_remote FROM ({MERGE_SIDE.format(k=0, m=7)}) a FULL JOIN ({MERGE_SIDE.format(k=1, m=11)}) b ON a.id = b.id",
        "job_pair_lookup": "SELECT s_suppkey, 'J-' || CAST(s_suppkey AS VARCHAR) AS number FROM supplier",
        "blob_difference": "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)",
        "correction_rows": q(f"SELECT id, c.field AS field, c.old AS old, c.new AS new FROM (SELECT id, unnest([{CHANGES}]) AS c FROM (SELECT id, trim(vendor) AS vendor, category FROM expenses)) WHERE c.old <> c.new"),
        "month_runs": """WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
            r AS (SELECT *, year(m) * 12 + month(m) - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS run FROM m),
            s AS (SELECT o_custkey, min(m) AS a, max(m) AS b FROM r GROUP BY o_custkey, run)
            SELECT o_custkey, string_agg(CASE WHEN a = b THEN strftime(a, '%b %Y') WHEN year(a) = year(b) THEN strftime(a, '%b') || '–' || strftime(b, '%b %Y') ELSE strftime(a, '%b %Y') || '–' || strftime(b, '%b %Y') END, ', ' ORDER BY a) AS months FROM s GROUP BY o_custkey""",
        "receipt_file_names": q("SELECT id, stem || CASE WHEN k = 1 THEN '' ELSE '_' || CAST(k AS VARCHAR) END || '.jpeg' AS file_name FROM (SELECT id, stem, row_number() OVER (PARTITION BY batch_id, stem ORDER BY id) AS k FROM named)", NAMED),
        "per_diem": f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR total > 100000000 THEN 0 ELSE {units('total')} END AS allowance FROM (SELECT c_custkey, floor(rate / 100.0::DOUBLE * days * 100 + 0.5) AS total FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE floor(c_acctbal * 100 + 0.5) END AS rate, least(366.0::DOUBLE, (c_custkey % 500) / 2.0::DOUBLE) AS days FROM customer))",
        "parse_amounts": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 3 THEN -c ELSE c END AS cents FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c FROM lineitem)",
        "currencies": "SELECT o_orderkey, ['GBP', 'EUR', 'MXN', 'USD', 'JPY', 'MXN', 'CHF'][o_orderkey % 7 + 1] AS currency FROM orders",
        "date_texts": """SELECT o_orderkey, CASE WHEN swap THEN make_date(year(d), day(d), month(d)) ELSE d END AS day, o_orderkey % 6 IN (1, 4) AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous
            FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS d, false AS swap FROM orders)""",
        "text_folds": """WITH m AS (SELECT p_partkey, p_name || '-' || p_brand || '-CORNER vvall 0158 cLue' AS t FROM part),
            g AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(lower(t), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'u', 'v'), '[^a-z0-9]+', ' ', 'g')) AS glyph FROM m)
            SELECT p_partkey, translate(lower(t), '015', 'ols') AS label, glyph, replace(translate(glyph, '0158', 'olsb'), ' ', '') AS "full" FROM g""",
        "alias_match": f"""WITH {ALIAS_TABLE}, {NOTES}, hits AS (SELECT p_partkey, name, category, alias, length(alias) AS l, strpos(lower(note), regexp_extract(lower(note), pattern)) + CASE WHEN regexp_extract(lower(note), pattern)[1:length(alias)] = alias THEN 0 ELSE 1 END AS pos FROM notes, alias WHERE regexp_matches(lower(note), pattern))
            SELECT p_partkey, name, category, alias FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY l DESC, pos, name DESC) AS r FROM hits) WHERE r = 1""",
        "category_rules": f"SELECT p_partkey, CASE {RULE_CASES} ELSE 'Other' END AS category FROM (SELECT p_partkey, lower('The ' || w || CASE WHEN p_partkey % 4 = 0 THEN 's' ELSE '' END || ' 24') AS shown FROM (SELECT p_partkey, {listed(KEYWORDS)}[p_partkey % {len(KEYWORDS)} + 1] AS w FROM part))",
        "brand_nearest": f"WITH {BRANDS} SELECT vec_id, brand, place, score FROM placed WHERE place = 1",
        "brand_topk": f"WITH {BRANDS} SELECT vec_id, place, score FROM placed WHERE place <= 3",
        "extract_roundtrip": f"""WITH {RECEIPTS} SELECT receipt, ['Shell', 'The Home Depot', 'Joe''s Diner', 'Marriott', 'Seaside Inn'][k + 1] AS vendor, day, c AS amount_cents, CAST(floor(c / 20.0::DOUBLE) AS BIGINT) AS tax_cents, 'USD' AS currency,
            ['Fuel', 'Materials', 'Meals', 'Lodging', 'Lodging'][k + 1] AS category, false AS review, concat_ws(';', CASE WHEN c > 100000 THEN 'large_amount:info' END, CASE WHEN DATE '2012-01-01' - day > 120 THEN 'stale_date:info' END) AS flags FROM receipts""",
        "locate_amounts": f"WITH {RECEIPTS} SELECT receipt, 6 AS line_no FROM receipts",
        "scorecard": "SELECT 1.0::DOUBLE AS vendor, 1.0::DOUBLE AS amount, 1.0::DOUBLE AS day, 1.0::DOUBLE AS category, 1.0::DOUBLE AS overall",
        "vision_replies": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS vendor, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey * 100 + 50 END AS cents FROM orders",
        "vendor_table": "SELECT upper(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Fuel' ELSE 'Other' END AS category, lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN '|' || lower(n_name) || ' co' ELSE '' END AS aliases FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0",
        "content_digests": "SELECT page_id, sha256(html) AS sha256 FROM pages",
        "stream_job_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id",
        "stream_seen_receipts": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
        "stream_lww": "SELECT coalesce(p.id, e.id) AS id, coalesce(e.value, p.value) AS value FROM (SELECT p_partkey AS id, p_retailprice AS value FROM part) p FULL JOIN (SELECT event_id % 500 + 1 AS id, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1) e ON p.id = e.id",
    }
