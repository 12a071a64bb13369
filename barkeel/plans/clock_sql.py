"""SQL that reads the mixed timestamp texts: common table expressions that end in ``clocks`` (rec_table, feed, rec_id, utc_us, readings).

Texts are cut by patterns of its own into date, time, fraction, half of the day and
zone; a local time is mapped by its zone and checked by mapping it back, at the
mapped instant and up to an hour beside it.
"""

CLOCKS = r"""
src AS (SELECT 'ohlcv_raw' AS rec_table, feed, raw_id AS rec_id, "timestamp" AS t FROM ohlcv_raw UNION ALL SELECT 'trade_log', feed, row_id, entry_time FROM trade_log),
c1 AS (SELECT rec_table, src.feed, rec_id, trim(regexp_replace(t, '[\s\x{a0}]+', ' ', 'g')) AS x, coalesce(zone_name, 'UTC') AS fz, upper(date_order) AS ord FROM src LEFT JOIN feeds ON feeds.feed = src.feed),
c2 AS (SELECT *, regexp_extract(x, '^(?:(?:[A-Za-z]{3,9}, ?)?(?:\d{1,2} +[A-Za-z]{3,9} +\d{4}|[A-Za-z]{3,9}\.? +\d{1,2},? +\d{4})|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{8}|\d{1,2}[/.]\d{1,2}[/.](?:\d{4}|\d{2})|\d{1,2}-[A-Za-z]{3,9}-(?:\d{4}|\d{2}))') AS dt FROM c1),
c3 AS (SELECT *, CASE WHEN dt <> '' THEN regexp_extract(substr(x, length(dt) + 1), '^[T ,-] ?(\d.*)$', 1) END AS rest FROM c2),
c4 AS (SELECT *, regexp_extract(rest, '^(\d{1,2}):?(\d{2}):?(\d{2})?(?:[.,](\d{1,12}))? ?(.*)$', ['h', 'mi', 's', 'frac', 'tail']) AS p,
  regexp_matches(rest, '^(?:\d{1,2}:\d{2}(?::\d{2})?|\d{6})(?:[.,]\d{1,12})?(?: ?[^\d:.,].*)?$') AS timed FROM c3),
c5 AS (SELECT *, upper(regexp_extract(p.tail, '^([AaPp])\.?[Mm]\.?(?: |$)', 1)) AS half, trim(regexp_replace(p.tail, '^[AaPp]\.?[Mm]\.?(?: |$)', '')) AS z FROM c4),
c6 AS (SELECT *, try_cast(p.h AS INT) AS h0, regexp_extract_all(dt, '\d+') AS n, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'],
    lower(substr(regexp_extract(dt, '([A-Za-z]{3,9})\.?[ -]+(?:\d|$)', 1), 1, 3))) AS mon FROM c5),
c7 AS (SELECT *, CASE WHEN half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END AS hh,
  CASE WHEN regexp_matches(dt, '^\d{4}[-/]') THEN [(n[1] || '-' || n[2] || '-' || n[3])]
       WHEN regexp_matches(dt, '^\d{8}$') THEN [substr(dt, 1, 4) || '-' || substr(dt, 5, 2) || '-' || substr(dt, 7, 2)]
       WHEN regexp_matches(dt, '^\d+/') THEN list_filter([CASE WHEN coalesce(ord, '') <> 'DMY' THEN right('20' || n[3], 4) || '-' || n[1] || '-' || n[2] END,
            CASE WHEN coalesce(ord, '') <> 'MDY' THEN right('20' || n[3], 4) || '-' || n[2] || '-' || n[1] END, CASE WHEN ord = 'YMD' AND length(n[3]) = 2 AND length(n[1]) = 2 THEN '20' || n[1] || '-' || n[2] || '-' || n[3] END], lambda v: v IS NOT NULL)
       WHEN regexp_matches(dt, '^\d+\.') THEN [right('20' || n[3], 4) || '-' || n[2] || '-' || n[1]]
       WHEN mon > 0 THEN [right('20' || n[2], 4) || '-' || mon || '-' || n[1]] END AS days FROM c6),
c8 AS (SELECT rec_table, feed, rec_id, z, fz, CAST(rpad(coalesce(p.frac, ''), 6, '0')[1:6] AS BIGINT) AS us, unnest(list_distinct(list_filter(list_transform(days, lambda d: CASE WHEN hh < 24 AND CAST(p.mi AS INT) < 60 AND CAST('0' || p.s AS INT) < 60
    THEN try_cast(d || ' ' || hh || ':' || p.mi || ':' || CASE WHEN p.s = '' THEN '00' ELSE p.s END AS TIMESTAMP) END), lambda v: v IS NOT NULL))) AS wall FROM c7 WHERE timed),
zn AS (SELECT * FROM (VALUES ('Z', 0), ('UTC', 0), ('GMT', 0), ('UT', 0), ('WET', 0), ('WEST', 60), ('CET', 60), ('CEST', 120), ('MET', 60), ('MEST', 120), ('EET', 120), ('EEST', 180), ('MSK', 180), ('JST', 540), ('KST', 540), ('HKT', 480), ('SGT', 480),
  ('AEST', 600), ('AEDT', 660), ('NZST', 720), ('NZDT', 780), ('EST', -300), ('EDT', -240), ('CDT', -300), ('MST', -420), ('MDT', -360), ('PST', -480), ('PDT', -420), ('BST', 60), ('BST', 360), ('IST', 60), ('IST', 120), ('IST', 330), ('CST', -360), ('CST', 480)) v(abbr, fixed)),
zl AS (SELECT abbr, list(fixed) AS offs FROM zn GROUP BY abbr),
c9 AS (SELECT *, CASE WHEN regexp_matches(z, '^[+-]\d{2}(:?\d{2})?$') THEN [CAST(substr(z, 1, 1) || '1' AS INT) * (CAST(substr(z, 2, 2) AS INT) * 60 + CAST('0' || right(replace(z, ':', ''), 2) AS INT) * CAST(length(z) > 3 AS INT))]
      WHEN len(offs) > 1 AND len(own) > 0 THEN own ELSE offs END AS off, CASE WHEN z = '' THEN fz WHEN contains(z, '/') THEN z END AS zone
  FROM (SELECT c.*, offs, list_filter(offs, lambda v: v = (epoch(jan) - epoch(timezone(fz, jan))) / 60 OR v = (epoch(jan + INTERVAL 181 DAY) - epoch(timezone(fz, jan + INTERVAL 181 DAY))) / 60) AS own FROM (SELECT *, date_trunc('year', wall) + INTERVAL 9 DAY AS jan FROM c8) c LEFT JOIN zl ON abbr = upper(z))),
c10 AS (SELECT rec_table, feed, rec_id, unnest(CASE WHEN off IS NOT NULL THEN list_transform(off, lambda m: epoch_us(wall) - CAST(m AS BIGINT) * 60000000 + us) WHEN zone IS NOT NULL THEN list_distinct(list_transform(
    list_filter([0, -60, 60, -30, 30], lambda k: timezone(zone, timezone(zone, wall) + to_minutes(k)) = wall), lambda k: epoch_us(timezone(zone, wall)) + CAST(k AS BIGINT) * 60000000 + us)) END) AS utc_us FROM c9),
c11 AS (SELECT rec_table, feed, rec_id, utc_us FROM c10 UNION SELECT rec_table, feed, rec_id, CASE length(x) WHEN 10 THEN CAST(x AS HUGEINT) * 1000000 WHEN 13 THEN CAST(x AS HUGEINT) * 1000 WHEN 16 THEN CAST(x AS HUGEINT) ELSE CAST(x AS HUGEINT) // 1000 END
  FROM c1 WHERE regexp_matches(x, '^(\d{10}|\d{13}|\d{16}|\d{19})$')),
clocks AS MATERIALIZED (SELECT rec_table, feed, rec_id, CAST(min(utc_us) AS BIGINT) AS utc_us, count(DISTINCT utc_us) AS readings FROM c11 GROUP BY ALL)
"""

#: After CLOCKS: ``cand`` has a text's readings with their form, found by mapping them back; ``way`` walks the records of a (table, feed) by id, forwards for the
#: costs (1 for a change of form, 2 for a step back in time) and backwards for the choice, where the earlier reading of a text goes first among equals.
CHOICE = r""",
seen AS (SELECT c.rec_table, c.feed, c.rec_id, c.utc_us, w.off IS NOT NULL AS named, CASE WHEN w.wall IS NULL THEN 100 + length(q.x) WHEN regexp_matches(q.dt, '^\d{4}[-/]') THEN 0 WHEN regexp_matches(q.dt, '^\d{8}$') THEN 1
    WHEN regexp_matches(q.dt, '^\d+/') THEN CASE WHEN coalesce(q.ord, '') <> 'DMY' AND try_cast(right('20' || q.n[3], 4) || '-' || q.n[1] || '-' || q.n[2] AS DATE) = CAST(w.wall AS DATE) THEN 2
         WHEN coalesce(q.ord, '') <> 'MDY' AND try_cast(right('20' || q.n[3], 4) || '-' || q.n[2] || '-' || q.n[1] AS DATE) = CAST(w.wall AS DATE) THEN 3 ELSE 4 END
    WHEN regexp_matches(q.dt, '^\d+\.') THEN 5 WHEN regexp_matches(q.dt, '^\d+-') THEN 6 WHEN regexp_matches(q.dt, '^([A-Za-z]+, ?)?\d') THEN 7 ELSE 8 END AS form
  FROM c11 c JOIN c7 q ON q.rec_table = c.rec_table AND q.rec_id = c.rec_id LEFT JOIN c9 w ON w.rec_table = c.rec_table AND w.rec_id = c.rec_id
    AND CASE WHEN w.off IS NOT NULL THEN list_contains(w.off, (epoch_us(w.wall) + w.us - c.utc_us) / 60000000) ELSE timezone(w.zone, make_timestamptz(CAST(c.utc_us - w.us AS BIGINT))) = w.wall END),
one AS (SELECT rec_table, feed, rec_id, CAST(utc_us AS BIGINT) AS utc_us, min(form) AS form, bool_or(named) AS named FROM seen GROUP BY ALL),
cand AS MATERIALIZED (SELECT rec_table, rec_id, utc_us, form, dense_rank() OVER (ORDER BY rec_table, feed) AS g, dense_rank() OVER (PARTITION BY rec_table, feed ORDER BY rec_id) AS n,
    row_number() OVER (PARTITION BY rec_table, rec_id ORDER BY form, CASE WHEN named THEN -utc_us ELSE utc_us END) AS i FROM one),
costs AS (SELECT g, n, i, form, utc_us, 0 AS cost FROM cand WHERE n = 1
  UNION ALL SELECT c.g, c.n, c.i, c.form, c.utc_us, min(p.cost + CAST(p.form <> c.form AS INT) + 2 * CAST(p.utc_us > c.utc_us AS INT)) FROM costs p JOIN cand c ON c.g = p.g AND c.n = p.n + 1 GROUP BY ALL),
paid AS MATERIALIZED (SELECT * FROM costs),
way AS (SELECT g, n, arg_min({'i': i, 'form': form, 'utc_us': utc_us}, row(cost, i)) AS c FROM paid WHERE (g, n) IN (SELECT (g, max(n)) FROM paid GROUP BY g) GROUP BY g, n
  UNION ALL SELECT p.g, p.n, arg_min({'i': p.i, 'form': p.form, 'utc_us': p.utc_us}, row(p.cost + CAST(p.form <> w.c.form AS INT) + 2 * CAST(p.utc_us > w.c.utc_us AS INT), p.i)) FROM way w JOIN paid p ON p.g = w.g AND p.n = w.n - 1 GROUP BY p.g, p.n)
"""
