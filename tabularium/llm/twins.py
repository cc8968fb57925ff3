"""SQL twins (DuckDB) of the queries that SQL can say, over whole tables."""

# The contract's patterns and least lengths.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((1, "assign", _ASSIGN), (2, "access", "AKIA[A-Z0-9]+"), (3, "hex", "[0-9a-f]+"))

SECRETS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, string_split(regexp_replace(t, '{p}', chr(1), 'g'), chr(1)) AS gaps, regexp_extract_all(t, '{p}') AS found FROM d" for k, kind, p in _KINDS
) + f"""), rows AS (SELECT doc_id, k, kind, unnest(gaps) AS gap, unnest(list_append(found, '')) AS m, generate_subscripts(gaps, 1) AS i FROM parts),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM rows),
kept AS (SELECT doc_id, k, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE m <> '' AND
  CASE k WHEN 1 THEN length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12 WHEN 2 THEN length(m) >= 18 ELSE length(m) >= 16 END),
listed AS (SELECT doc_id, count(*) FILTER (WHERE k = 1) AS n_assign, count(*) FILTER (WHERE k = 2) AS n_access, count(*) FILTER (WHERE k = 3) AS n_hex,
  string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) AS gs FROM w),
x AS (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM g),
hit AS (SELECT doc_id, i FROM x JOIN (SELECT g, min(doc_id) AS first FROM x GROUP BY g) USING (g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS gs FROM w),
x AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, CAST(any_value(len(gs)) AS BIGINT) AS n_shingles, min(b) AS component_id FROM reach JOIN s ON reach.a = s.doc_id GROUP BY a
"""

_FIVE = "CAST(concat('0x', substr(h, 5 * j + 1, 5)) AS INT)"
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda j: concat({', '.join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_FIVE} >> {b}) & 31), 1)" for b in (15, 10, 5, 0))})), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

_GROUP = "CAST(concat('0x', substr(sha256(concat('7:', doc_id)), {}, 8)) AS BIGINT)"
MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {', '.join(f"{_GROUP.format(8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

# States (n: nothing yet), insertions before a row, and edits of a row: letter, initial it needs, state after, cost.
_INSERTS = [(q, "I" * n, *x) for q, chain in (("n", "ua"), ("s", "ua"), ("u", "au"), ("a", "ua")) for n, x in ((0, (q, "")), (1, (chain[0], chain[:1])), (2, (chain[1], chain)))]
_EDITS = [*[(q, "D", "", q, 4) for q in "nsua"], ("n", "K", "s", "s", 0), *[(q, "K", i, i, 0) for q, i in ("nu", "su", "ua", "au")], *[(q, "R", "", i, 3) for q, i in ("nu", "su", "ua", "au")]]
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_SHOWN = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
_NAMED = "CASE {} WHEN 'u' THEN 'user' ELSE 'assistant' END"
TURNS = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split({_SHOWN}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS f FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, range(2) AS copies(c) WHERE f <> 0 AND (c = 0 OR f = 3)),
num AS (SELECT *, left(role, 1) AS init, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, ':', text))) AS i,
  rtrim(text, {_BLANKS}) AS solid FROM dam),
flt AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au'), false) AS wrong FROM num),
ins(q, letters, q2, added) AS (VALUES {', '.join(str(x) for x in _INSERTS)}), edit(q, op, needs, q3, price) AS (VALUES {', '.join(str(x) for x in _EDITS)}),
walk(conv_id, i, q, cost, audit, done) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'n', 0, '', CAST([] AS VARCHAR[]) FROM flt
  UNION ALL
  SELECT conv_id, i, q, cost, audit, done FROM (
    SELECT w.conv_id, r.i, e.q3 AS q, w.cost + 3 * length(n.letters) + e.price + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || n.letters || e.op AS audit,
      w.done || list_transform(list_filter(string_split(n.added, ''), lambda x: x <> ''), lambda x: {_NAMED.format('x')} || ':')
        || CASE op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [r.role || ':' || r.text] ELSE [{_NAMED.format('e.q3')} || ':' || r.text] END AS done
    FROM walk w JOIN ins n ON n.q = w.q JOIN flt r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN edit e ON e.q = n.q2
    WHERE (op = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (op <> 'K' OR e.needs = r.init))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ends AS (SELECT w.conv_id, w.cost + 3 * length(n.letters) AS cost, w.audit || n.letters AS audit,
    array_to_string(w.done || list_transform(list_filter(string_split(n.added, ''), lambda x: x <> ''), lambda x: {_NAMED.format('x')} || ':'), chr(10)) AS body
  FROM walk w JOIN ins n ON n.q = w.q AND n.q2 IN ('n', 'a') JOIN (SELECT conv_id, max(i) AS i FROM flt GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(n.letters), w.audit || n.letters) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE wrong) AS illegal FROM flt GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
