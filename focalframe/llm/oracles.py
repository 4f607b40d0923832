"""DuckDB SQL for the operators that SQL can express."""

from .license_scan import PHRASES, TEMPLATES

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i+2], ' ') END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS i) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (SELECT doc_id, hash(list(g ORDER BY g)) AS class FROM s GROUP BY doc_id
), reps AS (SELECT class, min(doc_id) AS doc_id FROM sets GROUP BY class
), rs AS (SELECT s.doc_id, s.g FROM s JOIN reps USING (doc_id)
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (SELECT doc_id, doc_id FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN reps r ON r.class = sets.class LEFT JOIN least l ON l.a = r.doc_id
"""

OP4 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0
), s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(sid - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM s1
), s3 AS (SELECT *, cap / weight AS full_at, sum(source_size) OVER () AS total FROM s2
), s4 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY full_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s3
), s5 AS (SELECT *, max(CASE WHEN lv <= full_at THEN lv END) OVER () AS level FROM s4
), s6 AS (SELECT source, sid, source_size, coalesce(CASE WHEN full_at <= level THEN cap ELSE level * weight END, cap) AS target, (source_size + 63) // 64 AS blocks FROM s5
), s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * blocks + 0.5) AS BIGINT) ELSE 0 END AS slots FROM s6
), j AS (SELECT sid, blocks, unnest(range(slots)) AS j FROM s WHERE slots > 0
), u AS (
  SELECT sid, ((CASE WHEN blocks % 15485863 <> 0 THEN 15485863 ELSE 15485867 END) * (j % blocks)
    + CAST('0x' || substr(md5('mix/' || sid || '/' || (j // blocks)), 1, 7) AS BIGINT)) % blocks AS block, count(*) AS uses FROM j GROUP BY 1, 2
), p AS (
  SELECT d.doc_id, d.source, d.size, s.sid, s.source_size, s.target,
    coalesce(sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.doc_id % 4096, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), b AS (SELECT sid, doc_id, start, size, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 + 1 AS BIGINT))) AS block FROM p WHERE size > 0
), t AS (SELECT b.sid, b.start, sum(u.uses * (least(b.start + b.size, (b.block + 1) * 64) - greatest(b.start, b.block * 64))) AS taken FROM b JOIN u ON u.sid = b.sid AND u.block = b.block GROUP BY 1, 2)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, CAST(CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM p LEFT JOIN t ON t.sid = p.sid AND t.start = p.start
"""


def _op6() -> str:
    """The tree's levels, unrolled."""
    steps = [
        r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0 OR (toxic = 0 AND quality = 1)) GROUP BY 1
), x AS (
  SELECT page_id, host, path, bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS l
  FROM p LEFT JOIN m ON m.doc_id = TRY_CAST(regexp_extract(p.path, '^/[^/]*/([0-9]+)', 1) AS BIGINT)
), r0 AS (
  SELECT page_id, host, path, bad, '' AS template, CASE WHEN len(l) > 4 THEN list_append(l[1:4], array_to_string(l[5:], '/')) ELSE l END AS parts FROM x
)"""
    ]
    for d in range(5):
        steps.append(f"""
, b{d} AS (
  SELECT host, template, parts[{d + 1}] AS seg, count(*) AS n, count(bad) AS known, sum(coalesce(bad, 0)) AS worse
  FROM r{d} WHERE parts[{d + 1}] IS NOT NULL GROUP BY 1, 2, 3
), c{d} AS (
  SELECT *, sum(n) OVER w AS all_n, sum(known) OVER w AS all_known, sum(worse) OVER w AS all_worse FROM b{d} WINDOW w AS (PARTITION BY host, template)
), n{d} AS (
  SELECT host, template, seg, CASE WHEN n < greatest(2.0, 0.05 * all_n) THEN '*'
    WHEN known > 0 AND all_known > known AND abs(worse / known - (all_worse - worse) / (all_known - known))
      > 1.96 * sqrt((all_worse / all_known) * (1 - all_worse / all_known) * (1.0 / known + 1.0 / (all_known - known))) THEN seg
    ELSE '+' END AS name FROM c{d}
), r{d + 1} AS (
  SELECT r.page_id, r.host, r.path, r.bad, r.template || CASE WHEN n.name IS NULL THEN '' ELSE '/' || n.name END AS template, r.parts
  FROM r{d} r LEFT JOIN n{d} n ON n.host = r.host AND n.template = r.template AND n.seg = r.parts[{d + 1}]
)""")
    steps.append("""
, leaf AS (SELECT host, template, count(bad) AS known, sum(CASE WHEN bad = 0 THEN 1 ELSE 0 END) AS good FROM r5 GROUP BY 1, 2
), h AS (SELECT host, sum(known) AS hk, sum(good) AS hg FROM leaf GROUP BY 1
), base AS (SELECT CASE WHEN sum(hk) > 0 THEN sum(hg) / sum(hk) ELSE 1.0 END AS base FROM h
), f AS (
  SELECT leaf.host, template, CAST((good + 4.0::DOUBLE * ((hg + 4.0::DOUBLE * base) / (hk + 4.0::DOUBLE))) / (known + 4.0::DOUBLE) AS DOUBLE) AS purity FROM leaf JOIN h USING (host), base
), v AS (
  SELECT r5.*, f.purity, CASE
    WHEN (r5.host = 'example.com' OR r5.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (r5.host = 'example.net' OR r5.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (r5.host = 'org' OR r5.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (r5.host = 'net' OR r5.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM r5 JOIN f ON f.host = r5.host AND f.template = r5.template
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity FROM v
""")
    return "".join(steps)


OP6 = _op6()

OP3 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    list_reduce(list_transform(range(0, 4), lambda c: list_reduce(list_transform(range(0, 8), lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || substr(hex, CAST(1 + 10 * c AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1]), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
  FROM p
), m AS (SELECT payload_digest, max(page_id) AS keep FROM d GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position FROM (
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN d.page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = keep THEN NULL ELSE keep END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.')), ',') || ')'
    || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)) AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM d JOIN m USING (payload_digest))
"""

OP5 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = r"""
WITH RECURSIVE crc(i, v, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), f AS (
  SELECT src.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS fault FROM src, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS said, substr(role, 1, 1) AS initial FROM o
), q AS (
  SELECT *, said = '' AS is_blank, said <> '' AND nth > 1 AS is_dup, said <> '' AND nth = 1 AND NOT regexp_matches(said, '[.!?]$') AS is_short,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS clash FROM p
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(is_blank) AS blank, count_if(is_dup) AS duplicate,
    count_if(is_short) AS truncated, count_if(clash) AS illegal, max(n) AS n FROM q GROUP BY conv_id
), back(conv_id, i, h) AS (
  SELECT conv_id, n + 1, [0, 4, 2, 0]::BIGINT[] FROM c UNION ALL
  SELECT conv_id, i, [least(e[1], e[3] + 2, e[4] + 4), least(e[2], e[3] + 2, e[4] + 4), least(e[3], e[4] + 2, e[3] + 4), least(e[4], e[3] + 2)] FROM (
    SELECT b.conv_id, q.i, [
      least(3 + h[1], CASE WHEN is_blank OR is_dup THEN 1000000 ELSE is_short::BIGINT + least(2 + h[3], CASE initial WHEN 's' THEN h[2] WHEN 'u' THEN h[3] ELSE 1000000 END) END),
      least(3 + h[2], CASE WHEN is_blank OR is_dup THEN 1000000 ELSE is_short::BIGINT + least(2 + h[3], CASE initial WHEN 'u' THEN h[3] ELSE 1000000 END) END),
      least(3 + h[3], CASE WHEN is_blank OR is_dup THEN 1000000 ELSE is_short::BIGINT + least(2 + h[4], CASE initial WHEN 'a' THEN h[4] ELSE 1000000 END) END),
      least(3 + h[4], CASE WHEN is_blank OR is_dup THEN 1000000 ELSE is_short::BIGINT + least(2 + h[3], CASE initial WHEN 'u' THEN h[3] ELSE 1000000 END) END)] AS e
    FROM back b JOIN q ON q.conv_id IS NOT DISTINCT FROM b.conv_id AND q.i = b.i - 1)
), hs AS (SELECT b.conv_id, b.i, b.h, x.h AS after, q.role, q.text, q.initial, q.is_short, q.is_blank OR q.is_dup AS must
  FROM back b LEFT JOIN back x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1 LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM b.conv_id AND q.i = b.i
), walk(conv_id, i, s, audit, lines, more) AS (
  SELECT conv_id, 1::BIGINT, 1, '', []::VARCHAR[], TRUE FROM c UNION ALL
  SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END, CASE e WHEN 'D' THEN s WHEN 'K' THEN keep ELSE nx END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE nx WHEN 3 THEN 'user:' ELSE 'assistant:' END)
      WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE nx WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) END, TRUE
  FROM (
    SELECT *, CASE WHEN after IS NOT NULL AND 3 + after[s] = h[s] THEN 'D' WHEN h[s] > 0 AND 2 + h[nx] = h[s] THEN 'I'
      WHEN after IS NOT NULL AND NOT must AND keep > 0 AND is_short::BIGINT + after[greatest(keep, 1)] = h[s] THEN 'K' WHEN after IS NOT NULL THEN 'R' END AS e
    FROM (
      SELECT w.conv_id, w.i, w.s, w.audit, w.lines, hs.h, hs.after, hs.role, hs.text, hs.must, hs.is_short, CASE WHEN w.s = 3 THEN 4 ELSE 3 END AS nx,
        CASE WHEN initial = 's' AND s = 1 THEN 2 WHEN initial = 'u' AND s <> 3 THEN 3 WHEN initial = 'a' AND s = 3 THEN 4 ELSE 0 END AS keep
      FROM walk w JOIN hs ON hs.conv_id IS NOT DISTINCT FROM w.conv_id AND hs.i = w.i)
  ) WHERE e IS NOT NULL
), r AS (
  SELECT c.*, b.h[1] AS cost, w.audit, w.lines FROM c JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
    JOIN (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id
"""

OP12 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 5 * length(w.text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > m.least THEN 'E' ELSE '' END) AS fails
  FROM w JOIN m USING (text) LEFT JOIN l ON l.doc_id = w.doc_id
), g AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY 1, 2
), o(p) AS (SELECT '' UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(p) < 5 AND NOT contains(p, x)
), s AS (SELECT p AS filter_order, CAST(k AS INTEGER) AS step, substr(p, k, 1) AS letter, substr(p, 1, k - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(p) = 5
), x AS (SELECT g.*, s.*, contains(fails, letter) AS own, regexp_matches(fails, '[' || before || '0]') AS early FROM g, s
), y AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT early THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT early THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND early THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT early THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT early THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y
"""


def _op13() -> str:
    """Every stretch of a notice's length against the notice, in texts that hold enough of its words at all."""
    part = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    notices = ", ".join(f"('{label}', '{notice}')" for label, notice in TEMPLATES)
    base = " UNION ALL ".join(
        f"SELECT row, i, '{label}' AS label FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE list_slice(w, i, i + {len(p.split()) - 1}) = {p.split()!r}" for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {part("coalesce(text, '')")} AS w FROM documents
), t AS (SELECT label, w, list_distinct(w) AS tokens, len(w) AS length, len(list_distinct(w)) AS m FROM (SELECT DISTINCT label, {part("notice")} AS w FROM (VALUES {notices}) v(label, notice))
), a AS (SELECT *, greatest(1, ceil(0.8 * m - 1e-9)) AS alpha FROM t
), pairs AS (SELECT d.row, d.w, a.* EXCLUDE (w) FROM d, a WHERE len(list_intersect(d.w, a.tokens)) >= a.alpha
), blocks AS (SELECT row, label, m, alpha, tokens, list_slice(w, s, s + length - 1) AS b FROM (SELECT *, unnest(range(1, greatest(1, len(w) - length + 1) + 1)) AS s FROM pairs)
), found AS (SELECT row, label, CAST(len(list_intersect(b, tokens)) AS DOUBLE) / m AS containment FROM blocks WHERE len(list_intersect(b, tokens)) >= alpha
), base AS ({base}
), bs AS (SELECT row, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, array_to_string(list(DISTINCT label ORDER BY label), ',') AS base_labels FROM base GROUP BY row
), ls AS (SELECT row, array_to_string(list(DISTINCT label ORDER BY label), ',') AS labels FROM (SELECT row, label FROM base UNION ALL SELECT row, label FROM found) GROUP BY row
), sc AS (SELECT row, max(containment) AS best FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (row) LEFT JOIN ls USING (row) LEFT JOIN sc USING (row)
"""


OP13 = _op13()
