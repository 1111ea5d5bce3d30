"""The queries once more as plain SQL, to hold their results against."""

from __future__ import annotations

from podia.plans.bindings import PROFILES, RESULTS, TABLES

_BANDS = "('U19', '19-29', '30-39', '40-49', '50-59', '60+')"
_BASE = f"""
raw AS ({RESULTS.format(**{t: t for t in TABLES})}),
results AS (
  SELECT *, substr(name_raw, 1, 1) || '○' AS name_masked,
    CASE WHEN regexp_matches(category_raw, '^[MW][0-9]') THEN '分齡' ELSE '未分類' END AS race_class,
    CASE WHEN regexp_matches(category_raw, '^M[0-9]') THEN 'M' WHEN regexp_matches(category_raw, '^W[0-9]') THEN 'F' END AS gender,
    CASE WHEN age < 13 THEN NULL WHEN age <= 18 THEN 'U19' WHEN age <= 29 THEN '19-29' WHEN age <= 39 THEN '30-39'
         WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59' WHEN age IS NOT NULL THEN '60+' END AS age_band
  FROM (SELECT *, TRY_CAST(regexp_extract(category_raw, '^[MW]([0-9]+)', 1) AS INTEGER) AS age FROM raw)
)"""
_KEYED = (
    _BASE
    + """,
anchor AS (
  SELECT name_raw AS nm, CASE WHEN count(DISTINCT tsu_rider_id) = 1 THEN min(tsu_rider_id) END AS tsu, CASE WHEN count(DISTINCT uci_id) = 1 THEN min(uci_id) END AS uci
  FROM results WHERE name_raw <> '' GROUP BY name_raw
),
keyed AS (
  SELECT *, substr(sha1('podia-athlete-v1|' || gk), 1, 10) AS id FROM (
    SELECT r.*, CASE WHEN tsu_rider_id IS NOT NULL THEN 't:' || tsu_rider_id WHEN uci_id IS NOT NULL THEN 'u:' || uci_id
                     WHEN tsu IS NOT NULL THEN 't:' || tsu WHEN uci IS NOT NULL THEN 'u:' || uci ELSE 'n:' || name_raw END AS gk
    FROM results r LEFT JOIN anchor a ON r.name_raw = a.nm)
),
gsize AS (SELECT gk, count(*) AS gn FROM keyed GROUP BY gk),
fields AS (SELECT race_key AS rk, year AS y, count(*) AS field FROM keyed GROUP BY 1, 2),
ranked_fields AS (SELECT race_key AS rk, year AS y, count(*) AS field FROM keyed WHERE rank_overall > 0 GROUP BY 1, 2),
full_rows AS (
  SELECT k.*, g.gn, f.field, CASE WHEN rank_overall >= 1 AND rank_overall <= field THEN (field - rank_overall) / CAST(field AS DOUBLE) * 100 END AS pct
  FROM keyed k JOIN gsize g USING (gk) JOIN fields f ON k.race_key = f.rk AND k.year = f.y
),
scored AS (
  SELECT k.*, f.field, CASE WHEN rank_overall >= 1 AND rank_overall <= field THEN (field - rank_overall) / CAST(field AS DOUBLE) * 100 END AS pct
  FROM keyed k LEFT JOIN ranked_fields f ON k.race_key = f.rk AND k.year = f.y
),
track AS (SELECT * FROM full_rows WHERE gn >= 2),
hist AS (
  SELECT id, CAST(row_number() OVER (PARTITION BY gk ORDER BY year, date, coalesce(rank_overall, 9999), row_ord) AS BIGINT) AS seq, year AS y, race_key AS rk,
         race_name_canonical AS rn, category_raw AS cat, gender AS g, team, rank_overall AS rank, finish_seconds AS t, result_label AS label, date AS d, field
  FROM track
)"""
)
_ENTRANTS = """
numbered AS (
  SELECT race_key || ' ' || CAST(year AS VARCHAR) AS book, year % 4 AS layout, CASE WHEN gender = 'F' THEN 0 WHEN gender = 'M' THEN 1 ELSE 2 END AS section, status, row_ord,
         CAST(finish_seconds AS BIGINT) AS t
  FROM results
),
entrants AS (
  SELECT *, CASE section WHEN 0 THEN '女子菁英組' WHEN 1 THEN '男子青年組' ELSE '男子大師組' END AS category, CAST(n % 10000 AS VARCHAR) AS bib,
         translate(lpad(CAST(row_ord % 10000 AS VARCHAR), 4, '0'), '0123456789', '王李張陳林黃吳劉蔡楊') AS name,
         CASE WHEN row_ord % 11 <> 0 THEN '車隊' || CAST(row_ord % 60 AS VARCHAR) END AS team, '1000' || lpad(CAST(row_ord % 1000000 AS VARCHAR), 6, '0') AS licence
  FROM (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY t NULLS LAST, row_ord) AS n FROM numbered)
)"""
_SLIM = """,
slim AS (
  SELECT race_key AS rk, year AS y, CAST(substr(date, 6, 2) AS BIGINT) AS mon, series AS s, race_class AS rc, category_raw AS cat, gender AS g, age_band AS ag,
         CAST(floor(finish_seconds) AS BIGINT) AS t, rank_overall AS rank, CAST(NULL AS BIGINT) AS dist, CAST(NULL AS DOUBLE) AS spd, source_platform AS plat, region AS reg
  FROM results WHERE status IS NULL OR status = 'FIN'
)"""
_DIFF = """,
yearly AS (SELECT race_key AS rk, result_label AS label, year AS y, median(finish_seconds) AS m, count(*) AS n FROM results WHERE finish_seconds > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 20),
base AS (SELECT rk, label, median(m) AS b FROM yearly GROUP BY 1, 2 HAVING count(*) >= 2),
diff AS (SELECT rk, label, y, CAST(round_even(b, 0) AS BIGINT) AS baseline, CAST(round_even(m, 0) AS BIGINT) AS median, round(m / b, 4) AS coeff, n FROM yearly JOIN base USING (rk, label))"""
_TEAMS = """,
named AS (SELECT * FROM full_rows WHERE team IS NOT NULL AND team <> '個人'),
real AS (SELECT team FROM named GROUP BY team HAVING count(DISTINCT gk) >= 4 AND count(DISTINCT race_key) >= 2),
squad AS (SELECT * FROM named JOIN real USING (team))"""
_PROFILES = ", ".join(f"('{k}', {e}, {g})" for k, e, _, g in PROFILES)
_CLIMBS = f""",
profile(race_key, elev, grade) AS (VALUES {_PROFILES}),
ascent AS (
  SELECT *, round(CAST(vam AS DOUBLE) / (100 * (2 + CAST(grade AS DOUBLE) / 10)), 1) AS wkg FROM (
    SELECT f.*, p.grade, p.elev, CAST(round_even(elev / (finish_seconds / 3600), 0) AS BIGINT) AS vam FROM full_rows f JOIN profile p USING (race_key) WHERE finish_seconds > 0)
  WHERE vam BETWEEN 100 AND 3000
)"""
_INDEX = """,
idx AS (
  SELECT gk, id, 'x' AS one, count(*) AS n, count(DISTINCT year) AS ny, count(DISTINCT race_key) AS nr, min(year) AS y0, max(year) AS y1, min(rank_overall) AS best,
         count(DISTINCT team) AS teams, count(DISTINCT gender) AS genders, length(replace(arg_min(name_raw, row_ord), ' ', '')) AS len
  FROM track GROUP BY gk, id
),
names AS (SELECT gk, arg_min(name_masked, (-n, f)) AS nm FROM (SELECT gk, name_masked, count(*) AS n, min(row_ord) AS f FROM track GROUP BY 1, 2) GROUP BY gk),
tms AS (SELECT gk, arg_max(team, (year, row_ord)) AS tm FROM track WHERE team IS NOT NULL AND team <> '個人' GROUP BY gk),
athletes AS (
  SELECT id, nm, n, ny, nr, y0, y1, best,
         CASE WHEN gk LIKE 't:%' OR gk LIKE 'u:%' THEN 'high' WHEN genders > 1 THEN 'low' WHEN teams >= 5 THEN 'low'
              WHEN teams >= 3 AND len <= 2 THEN 'low' WHEN teams >= 3 THEN 'med' ELSE 'high' END AS conf,
         gk LIKE 'u:%' AS uci, gk LIKE 't:%' AS rid, tm
  FROM idx JOIN names USING (gk) LEFT JOIN tms USING (gk)
)"""
_BENCH = """,
timed AS (SELECT *, CAST(floor(finish_seconds) AS BIGINT) AS t FROM results WHERE finish_seconds IS NOT NULL AND (status IS NULL OR status = 'FIN')),
cohorts AS (
  SELECT race_key AS rk, result_label AS label, 'all' AS cohort, 'all' AS type, t FROM timed
  UNION ALL SELECT race_key, result_label, 'age:' || age_band, 'age', t FROM timed WHERE age_band IS NOT NULL
  UNION ALL SELECT race_key, result_label, 'age:' || age_band || '|g:' || gender, 'age', t FROM timed WHERE age_band IS NOT NULL AND gender IS NOT NULL
  UNION ALL SELECT race_key, result_label, 'cat:' || category_raw, 'cat', t FROM timed
),
lists AS (SELECT rk, label, cohort, type, count(*) AS n, list_sort(list(t)) AS ts FROM cohorts GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20),
bench AS (
  SELECT rk, label, cohort, type, n, list_transform(range(0, 101), lambda p: ts[CAST(round_even(p / 100.0::DOUBLE * (n - 1), 0) AS BIGINT) + 1]) AS bp
  FROM lists WHERE (rk, label) IN (SELECT (rk, label) FROM lists WHERE cohort = 'all')
)"""


def _q(select: str, *parts: str) -> str:
    return "WITH " + "".join(parts or (_BASE,)) + "\n" + select


_UP = "CAST(floor({} + 0.5) AS BIGINT)"

ORACLE: dict[str, str] = {
    "fn_courses": """
        SELECT p_partkey, CAST(km AS BIGINT) AS km, CASE WHEN km / (price / 3600.0) <= 80 THEN round(km / (price / 3600.0), 1) END AS spd, CAST(vam AS BIGINT) AS vam,
               round(vam / (100 * (2 + 0.65::DOUBLE)), 1) AS wkg, CASE WHEN p_name LIKE '%hot%' THEN 'climb' WHEN p_name LIKE '%ring%' THEN 'crit' WHEN p_name LIKE '%red%' THEN 'tt' ELSE 'road' END AS kind
        FROM (SELECT *, CASE WHEN p_size * 7 BETWEEN 10 AND 700 THEN p_size * 7 END::DOUBLE AS km, CASE WHEN p_size > 0 THEN round_even(p_size * 40 / (price / 3600), 0) END AS vam
              FROM (SELECT *, (floor(p_retailprice) + 600)::DOUBLE AS price FROM part))""",
    "records": _q("SELECT row_ord, race_key, year, gender, age_band, race_class, name_masked, rank_overall, finish_seconds FROM results"),
    "merge_dedup": _q(
        """, both_rows AS (
          SELECT source_ord, row_ord, name_raw, year, name_masked, finish_seconds, status FROM results
          UNION ALL SELECT 9, row_ord, CASE WHEN row_ord % 3 = 0 THEN substr(name_raw, 1, 1) || '*' ELSE name_raw END, year, name_masked, finish_seconds, status FROM results WHERE row_ord % 4 = 0),
        masked AS (
          SELECT *, substr(name_raw, 1, 1) || '○' AS m, CAST(floor(finish_seconds) AS BIGINT) AS s, name_raw LIKE '%*%' AS hidden FROM both_rows
          WHERE status IN ('DNF', 'DNS') OR finish_seconds IS NULL OR finish_seconds > 0),
        seen AS (
          SELECT *, min(CASE WHEN NOT hidden THEN (source_ord, row_ord) END) OVER (PARTITION BY year, name_raw, s) AS first_named,
                 first_value(hidden) OVER w AS first_is_hidden, (first_value(source_ord) OVER w, first_value(row_ord) OVER w) AS first_masked
          FROM masked WINDOW w AS (PARTITION BY year, m, s ORDER BY source_ord, row_ord))
        SELECT source_ord, row_ord, name_raw FROM seen
        WHERE s IS NULL OR NOT (CASE WHEN hidden THEN first_masked < (source_ord, row_ord)
                                ELSE first_named < (source_ord, row_ord) OR (first_is_hidden AND first_masked < (source_ord, row_ord)) END)""",
        _BASE,
    ),
    "merge_summary": _q(
        """SELECT facet, value, count(*) AS rows, count(*) FILTER (WHERE status IS NULL OR status = 'FIN') AS finishers FROM (
          SELECT 'all' AS facet, CAST(NULL AS STRING) AS value, status FROM results UNION ALL SELECT 'platform', source_platform, status FROM results
          UNION ALL SELECT 'year', CAST(year AS STRING), status FROM results UNION ALL SELECT 'gender', gender, status FROM results
          UNION ALL SELECT 'class', race_class, status FROM results UNION ALL SELECT 'series', series, status FROM results UNION ALL SELECT 'status', status, status FROM results)
        GROUP BY 1, 2"""
    ),
    "merge_races": _q("SELECT race_key, count(*) AS rows, min(year) AS y0, max(year) AS y1, count(DISTINCT year) AS years FROM results GROUP BY 1"),
    "quality_report": _q(
        """SELECT u.issue, u.rows FROM (SELECT unnest([
            {'issue': 'missing_time', 'rows': count(*) FILTER (WHERE finish_seconds IS NULL)}, {'issue': 'missing_name', 'rows': count(*) FILTER (WHERE name_raw IS NULL)},
            {'issue': 'missing_race', 'rows': count(*) FILTER (WHERE race_name_canonical IS NULL)}, {'issue': 'time_unparsed', 'rows': 0},
            {'issue': 'time_out_of_range', 'rows': count(*) FILTER (WHERE NOT finish_seconds BETWEEN 480 AND 216000)},
            {'issue': 'year_mismatch', 'rows': count(*) FILTER (WHERE CAST(nullif(regexp_extract(race_name_raw, '20[0-2][0-9]'), '') AS BIGINT) BETWEEN 2009 AND 2027
               AND CAST(nullif(regexp_extract(race_name_raw, '20[0-2][0-9]'), '') AS BIGINT) <> year)}]) AS u FROM results)"""
    ),
    "quality_duplicates": _q("SELECT race_key, year, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT race_key, year, category_raw, bib, finish_seconds, count(*) AS n FROM results GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1) GROUP BY 1, 2"),
    "quality_inversions": _q(
        """SELECT race_key, year, result_label, count(*) AS inversions FROM (
          SELECT race_key, year, result_label, finish_seconds, max(finish_seconds) OVER (PARTITION BY race_key, year, result_label ORDER BY rk, row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slowest
          FROM (SELECT *, CASE WHEN bib = 2 THEN rank_overall + 3 ELSE rank_overall END AS rk FROM results) WHERE rk > 0 AND finish_seconds IS NOT NULL)
        WHERE finish_seconds + 1e-6 < slowest GROUP BY 1, 2, 3"""
    ),
    "quality_coverage": _q("SELECT source_platform, count(*) AS rows, count(gender) AS gender_known, count(age_band) AS age_known FROM results GROUP BY 1"),
    "compare_builds": _q(
        """, old AS (SELECT race_key AS rk, year AS y, bib FROM results WHERE status IS NULL OR status = 'FIN')
        SELECT rk, y, CASE WHEN new_rows = 0 THEN 'missing' WHEN old_rows = new_rows THEN 'same' ELSE 'changed' END AS state, old_rows, new_rows, old_rows - new_rows AS lost FROM (
          SELECT rk, y, count(*) AS old_rows, count(*) FILTER (WHERE NOT (rk = 'Brand#2' AND y = 1996) AND NOT (rk = 'Brand#4' AND bib = 3)) AS new_rows FROM old GROUP BY 1, 2)""",
        _BASE,
    ),
    "identity_keys": _q("SELECT row_ord, gk, id FROM keyed", _KEYED),
    "athletes_index": _q("SELECT * FROM athletes", _KEYED, _INDEX),
    "athletes_history": _q("SELECT * FROM hist", _KEYED),
    "athletes_traits": _q(
        """SELECT id, discipline, round(median(pct), 1) AS pct, count(*) AS n FROM (
          SELECT id, pct, CASE WHEN race_name_raw LIKE '%hot%' THEN 'climb' WHEN race_name_raw LIKE '%ring%' THEN 'crit' WHEN race_name_raw LIKE '%red%' THEN 'tt' ELSE 'road' END AS discipline
          FROM track WHERE pct IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 2""",
        _KEYED,
    ),
    "athletes_climbs": _q(
        """SELECT id, any_value(nm) AS nm, max(vam) AS best_vam, arg_max(wkg, (vam, -row_ord)) AS best_wkg,
                  'Mount ' || arg_max(race_key, (vam, -row_ord)) AS climb, CASE WHEN arg_max(elev, (vam, -row_ord)) > 2000 THEN 'high' ELSE 'med' END AS conf, arg_max(year, (vam, -row_ord)) AS y, nullif(arg_max(coalesce(gender, ''), (vam, -row_ord)), '') AS g
           FROM ascent JOIN names USING (gk) WHERE gn >= 2 GROUP BY id""",
        _KEYED, _INDEX, _CLIMBS,
    ),
    "course_records": _q(
        """, best AS (SELECT race_key AS rk, gk, id, arg_min(name_masked, (finish_seconds, row_ord)) AS nm, min(finish_seconds) AS s, arg_min(row_ord, (finish_seconds, row_ord)) AS o,
               arg_min(vam, (finish_seconds, row_ord)) AS vam, arg_min(wkg, (finish_seconds, row_ord)) AS wkg, arg_min(year, (finish_seconds, row_ord)) AS y,
               arg_min(coalesce(gender, ''), (finish_seconds, row_ord)) AS g, arg_min(category_raw, (finish_seconds, row_ord)) AS cat, max(gn) >= 2 AS link FROM ascent GROUP BY 1, 2, 3)
        SELECT rk, rank, id, nm, CAST(floor(s) AS BIGINT) AS t, vam, wkg, y, nullif(g, '') AS g, cat, link, n, name, dist_km, elev_m, grade FROM (
          SELECT *, row_number() OVER (PARTITION BY rk ORDER BY s, o) AS rank, count(*) OVER (PARTITION BY rk) AS n FROM best) JOIN (SELECT race_key AS rk, 'Mount ' || race_key AS name, dist_km, elev_m, CAST(grade AS DOUBLE) AS grade FROM (VALUES %s) v(race_key, elev_m, dist_km, grade)) USING (rk) WHERE rank <= 50""" % ", ".join(f"('{k}', {e}, CAST({d} AS DOUBLE), {g})" for k, e, d, g in PROFILES),
        _KEYED, _CLIMBS,
    ),
    "athletes_rivals": _q(
        """, act AS (SELECT gk, id, race_key AS rk, year AS y, rank_overall AS r FROM keyed WHERE rank_overall > 0 AND gk IN (SELECT gk FROM keyed WHERE rank_overall > 0 GROUP BY gk HAVING count(*) >= 6)),
        pairs AS (SELECT a.id AS id, b.id AS rival, count(*) FILTER (WHERE a.r < b.r) AS w, count(*) AS meets FROM act a JOIN act b ON a.rk = b.rk AND a.y = b.y AND a.gk <> b.gk AND a.r <> b.r GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT id, place, rival, w, meets - w AS l, meets FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY meets DESC, w DESC, rival) AS place FROM pairs) WHERE place <= 6""",
        _KEYED,
    ),
    "athletes_careers": _q("SELECT id, count(*) AS races, count(DISTINCT y) AS years, min(y) AS y0, max(y) AS y1, count(*) FILTER (WHERE rank = 1) AS wins, count(*) FILTER (WHERE rank <= 3) AS podiums, min(rank) AS best_rank FROM hist GROUP BY id", _KEYED),
    "athletes_progression": _q(f"SELECT id, y, max({_UP.format('(field - rank) / CAST(field AS DOUBLE) * 100')}) AS pct, count(*) AS races, min(rank) AS best_rank FROM hist GROUP BY 1, 2", _KEYED),
    "athletes_highlights": _q(
        f""", p AS (SELECT *, {_UP.format('(field - rank) / CAST(field AS DOUBLE) * 100')} AS p FROM hist WHERE rank IS NOT NULL)
        SELECT id, arg_max(rk, (p, d, -seq)) AS best_rk, arg_max(y, (p, d, -seq)) AS best_y, max(p) AS best_pct, arg_max(rk, (d, -seq)) AS latest_rk, arg_max(y, (d, -seq)) AS latest_y, arg_max(p, (d, -seq)) AS latest_pct FROM p GROUP BY id""",
        _KEYED,
    ),
    "athletes_seasons": _q(
        f""", p AS (SELECT *, {_UP.format('(field - rank) / CAST(field AS DOUBLE) * 100')} AS p, CAST(substr(d, 6, 2) AS BIGINT) AS month FROM hist),
        per AS (SELECT id, y, count(*) AS races, {_UP.format('median(p)')} AS median_pct, max(p) AS best_pct, count(*) FILTER (WHERE rank = 1) AS wins, count(*) FILTER (WHERE rank <= 3) AS podiums FROM p GROUP BY 1, 2),
        busy AS (SELECT id, y, arg_min(month, (-n, f)) AS busiest_month FROM (SELECT id, y, month, count(*) AS n, min(seq) AS f FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT a.*, busiest_month, a.median_pct - b.median_pct AS delta FROM per a LEFT JOIN busy USING (id, y) LEFT JOIN per b ON a.id = b.id AND a.y = b.y + 1""",
        _KEYED,
    ),
    "athletes_compared": _q(
        """, two AS (SELECT id, row_number() OVER (ORDER BY count(*) DESC, id) AS k FROM hist GROUP BY id QUALIFY k <= 2),
        best AS (SELECT k, rk, y, min(rank) AS r FROM hist JOIN two USING (id) GROUP BY 1, 2, 3)
        SELECT a.rk, a.y, a.r AS a_rank, b.r AS b_rank, CASE WHEN a.r < b.r THEN 'a' WHEN b.r < a.r THEN 'b' ELSE 'tie' END AS winner FROM best a JOIN best b ON a.rk = b.rk AND a.y = b.y AND a.k = 1 AND b.k = 2""",
        _KEYED,
    ),
    "athletes_search": _q("SELECT * FROM athletes WHERE lower(replace(replace(nm, '○', ''), ' ', '')) LIKE '%f%' ORDER BY n DESC, ny DESC, coalesce(best, 9999), id LIMIT 20", _KEYED, _INDEX),
    "athletes_calibrated": _q(
        f"SELECT id, rk, y, arg_min(t, (t, seq)) AS raw, {_UP.format('arg_min(t, (t, seq)) / arg_min(coeff, (t, seq))')} AS calibrated, arg_min(coeff, (t, seq)) AS coeff FROM hist JOIN diff USING (rk, label, y) WHERE t > 0 GROUP BY 1, 2, 3",
        _KEYED, _DIFF,
    ),
    "races_slim": _q("SELECT * FROM slim", _BASE, _SLIM),
    "races_index": _q(
        """, multi AS (SELECT race_key, count(DISTINCT year) > 1 AS multi_year, arg_max({'s': series}, (source_ord, row_ord)).s AS s FROM results GROUP BY 1)
        SELECT race_key AS rk, year AS y, race_key AS rn, any_value(s) AS s, count(*) FILTER (WHERE status IS NULL OR status = 'FIN') AS rows, any_value(multi_year) AS multi_year, bool_or(team IS NOT NULL) AS has_team,
               replace(race_key, '#', '-') || '__' || CAST(year AS STRING) AS file, min(date) AS d, count(*) FILTER (WHERE status = 'FIN') AS fin, count(status) AS total,
               CASE WHEN count(status) > 0 THEN round(count(*) FILTER (WHERE status = 'FIN') / CAST(count(status) AS DOUBLE), 3) END AS rate,
               count(*) FILTER (WHERE status = 'DNF') AS not_finished, count(*) FILTER (WHERE status = 'DNS') AS not_started, CAST(0 AS BIGINT) AS unknown
        FROM results JOIN multi USING (race_key) GROUP BY 1, 2""",
        _BASE,
    ),
    "races_leaderboard": _q(
        """SELECT race_key AS rk, year AS y, category_raw AS cat, result_label AS label, name_masked AS name, bib, gender AS g, team, rank_overall AS rank, finish_seconds AS t,
           CASE WHEN finish_seconds IS NOT NULL THEN row_number() OVER (PARTITION BY race_key, year, category_raw, result_label, finish_seconds IS NULL ORDER BY finish_seconds, row_ord) END AS place, row_ord
           FROM results WHERE status IS NULL OR status = 'FIN'"""
    ),
    "races_groups": _q(
        """SELECT rk, y, cat, label, CASE WHEN count(*) OVER (PARTITION BY rk, y, cat) > 1 THEN cat || ' · ' || label ELSE cat END AS name, n FROM (
          SELECT race_key AS rk, year AS y, category_raw AS cat, result_label AS label, count(*) AS n FROM results WHERE status IS NULL OR status = 'FIN' GROUP BY 1, 2, 3, 4)"""
    ),
    "races_team_strength": _q(
        """SELECT rk, y, team, top, podium FROM (SELECT *, row_number() OVER (PARTITION BY rk, y ORDER BY top DESC, podium DESC, team) AS p FROM (
          SELECT race_key AS rk, year AS y, team, count(*) FILTER (WHERE rank_overall <= 10) AS top, count(*) FILTER (WHERE rank_overall <= 3) AS podium FROM results
          WHERE (status IS NULL OR status = 'FIN') AND team IS NOT NULL AND rank_overall IS NOT NULL GROUP BY 1, 2, 3) WHERE top > 0) WHERE p <= 10"""
    ),
    "races_crossyear": _q(
        """SELECT rk, label, y, winner, median, p25, p75, n FROM (SELECT *, count(*) OVER (PARTITION BY rk, label) AS years FROM (
          SELECT race_key AS rk, result_label AS label, year AS y, CAST(floor(min(finish_seconds)) AS BIGINT) AS winner, CAST(round_even(quantile_cont(floor(finish_seconds), 0.5), 0) AS BIGINT) AS median,
                 CAST(round_even(quantile_cont(floor(finish_seconds), 0.25), 0) AS BIGINT) AS p25, CAST(round_even(quantile_cont(floor(finish_seconds), 0.75), 0) AS BIGINT) AS p75, count(*) AS n
          FROM results WHERE finish_seconds IS NOT NULL AND (status IS NULL OR status = 'FIN') GROUP BY 1, 2, 3)) WHERE years >= 2"""
    ),
    "races_difficulty": _q("SELECT * FROM diff", _BASE, _DIFF),
    "races_severity": _q(
        f""", main AS (SELECT rk, arg_max(label, (a, label)) AS label, arg_max(u, (a, label)) AS usual FROM (SELECT rk, label, sum(n) AS a, median(n) AS u FROM diff GROUP BY 1, 2) GROUP BY rk),
        d AS (SELECT rk, y, label, n, {_UP.format('(n / CAST(usual AS DOUBLE) - 1) * 100')} AS finisher_delta, {_UP.format('(coeff - 1) * 100')} AS time_delta FROM diff JOIN main USING (rk, label))
        SELECT *, CASE WHEN finisher_delta <= -20 AND time_delta >= 5 THEN '嚴苛' WHEN finisher_delta <= -20 OR time_delta >= 5 THEN '偏難'
                       WHEN finisher_delta >= 0 AND time_delta <= -5 THEN '偏易' ELSE '正常' END AS verdict FROM d""",
        _BASE, _DIFF,
    ),
    "races_benchmarks": _q(
        """SELECT rk, label, cohort, type, n, array_to_string(bp, ',') AS bp, years FROM bench JOIN (
          SELECT race_key AS rk, result_label AS label, string_agg(DISTINCT CAST(year AS STRING), ',' ORDER BY CAST(year AS STRING)) AS years
          FROM results WHERE (status IS NULL OR status = 'FIN') AND finish_seconds IS NOT NULL GROUP BY 1, 2) USING (rk, label)""",
        _BASE, _BENCH,
    ),
    "fn_names": """
        SELECT c_custkey, CASE WHEN k % 3 = 0 THEN substr(c_name, 1, 1) || '○'
                               WHEN k % 3 = 2 THEN substr(c_mktsegment, 1, 1) || '○ ' || substr(lower(c_mktsegment), 1, 1) || '○'
                               WHEN length(cjk) = 1 THEN cjk WHEN length(cjk) = 2 THEN substr(cjk, 1, 1) || '○'
                               ELSE substr(cjk, 1, 1) || repeat('○', length(cjk) - 2) || substr(cjk, -1, 1) END AS masked,
               2009 + k % 12 AS year, '彰化經典' || CAST(k % 9 AS STRING) || 'K春' AS race_key, CAST(typed AS DOUBLE) AS seconds, typed
        FROM (SELECT *, c_custkey AS k, substr('王大明陳小美李林', CAST(c_custkey % 5 + 1 AS INTEGER), CAST(c_custkey % 4 + 1 AS INTEGER)) AS cjk,
                     CAST(c_custkey % 24 * 3600 + c_custkey % 60 * 60 + c_custkey % 59 AS BIGINT) AS typed FROM customer)""",
    "fn_divisions": """
        SELECT p_partkey, division, nullif(substr(seg, length(division) + 1), '') AS team, gender, age,
               CASE WHEN age LIKE 'U%' THEN 'U19' WHEN age = 'MASTER' THEN age WHEN CAST(substr(age, 1, 2) AS INTEGER) BETWEEN 19 AND 29 THEN '19-29' WHEN age IS NOT NULL THEN '40-49' END AS band,
               CASE WHEN label LIKE '%挑戰%' THEN '挑戰' WHEN label = '國中' OR division LIKE 'U%' THEN '青少年' WHEN label = 'TTT' THEN '團體計時' WHEN label = '市民' THEN '市民'
                    WHEN label = '完賽' THEN '認證' WHEN regexp_matches(division, '^[MW][0-9]') OR division = 'MASTER' THEN '分齡' WHEN division LIKE '女子%' THEN '女子' ELSE '未分類' END AS race_class
        FROM (SELECT *, CASE WHEN regexp_matches(division, '^W|女') THEN 'F' WHEN division LIKE 'M%' THEN 'M' END AS gender,
                     CASE WHEN division IN ('MASTER') OR division LIKE 'U%' THEN division ELSE nullif(regexp_extract(division, '[0-9].*'), '') END AS age
              FROM (SELECT *, regexp_extract(seg, '^(MASTER|女子組|菁英組|公開|[MW][0-9]+-[0-9]+|[MW][0-9]+|U[0-9]+)', 1) AS division
                    FROM (SELECT p_partkey, replace(list_extract(['M24-35宜蘭隊', 'W40', '女子組 隊', 'U15青年', 'MASTER老將', '菁英組A', '公開車隊'], CAST(p_partkey % 7 + 1 AS INTEGER)), ' ', '') AS seg,
                                 list_extract(['挑戰組', '國中', '市民', '', 'TTT', '完賽'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS label FROM part)))""",
    "merge_masked_teams": _q("SELECT team, count(*) AS n FROM (SELECT CASE WHEN row_ord % 17 = 0 THEN substr(name_raw, 1, 1) || '○ L○' ELSE team END AS team FROM results) GROUP BY 1"),
    "races_distance_speed": _q(
        """SELECT laps + 50 AS dist, round((laps + 50) / (finish_seconds / 3600), 1) AS spd, race_class AS rc FROM results
           WHERE (status IS NULL OR status = 'FIN') AND finish_seconds > 0 AND (laps + 50) / (finish_seconds / 3600) <= 80"""
    ),
    "quality_shrunk_sources": _q(
        """SELECT source_platform, CAST(sum(CASE WHEN source_platform LIKE '1%' THEN 1 WHEN row_ord % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS rows, count(DISTINCT row_ord) AS results
           FROM results GROUP BY 1"""
    ),
    "races_summaries": _q(
        f""", own AS (SELECT *, split_part(result_label, ' ', 1) AS lab FROM results),
        timed AS (SELECT *, coalesce(category_raw, lab, '') AS g FROM own WHERE finish_seconds IS NOT NULL AND (status IS NULL OR status = 'FIN')),
        grps AS (SELECT race_key AS rk, year AS y, g, count(*) AS n, median(finish_seconds) AS median, min(finish_seconds) AS winner FROM timed GROUP BY 1, 2, 3),
        top AS (SELECT *, sum(n) OVER (PARTITION BY rk, y) AS finishers, count(*) OVER (PARTITION BY rk, y) AS gs FROM grps QUALIFY row_number() OVER (PARTITION BY rk, y ORDER BY n DESC, g) = 1),
        comp AS (SELECT race_key AS rk, year AS y, {_UP.format("100 * round(count(*) FILTER (WHERE status = 'FIN') / CAST(count(status) AS DOUBLE), 3)")} AS rate_pct FROM own GROUP BY 1, 2),
        pts AS (SELECT race_key AS rk, lab AS label, year AS y, CAST(round_even(quantile_cont(floor(finish_seconds), 0.5), 0) AS BIGINT) AS m, count(*) AS n FROM timed GROUP BY 1, 2, 3),
        steps AS (SELECT *, lag(y) OVER w AS py, lag(m) OVER w AS pm, lag(n) OVER w AS pn FROM pts WINDOW w AS (PARTITION BY rk, label ORDER BY y)),
        fit AS (SELECT *, CAST(m - pm AS DOUBLE) / pm * 100 AS pct FROM steps WHERE n >= 30 AND pn >= 30 AND n <= 2 * pn AND pn <= 2 * n),
        chg AS (SELECT * FROM fit WHERE abs(pct) <= 15 QUALIFY row_number() OVER (PARTITION BY rk, y ORDER BY n DESC, label) = 1)
        SELECT rk, y, CAST(coalesce(finishers, 0) AS BIGINT) AS finishers, CASE WHEN gs > 1 THEN g END AS grp, coalesce(top.n, 0) AS grp_finishers, median, winner, rate_pct,
               label AS chg_label, py AS chg_prev_y, m - pm AS chg_seconds, CAST(floor(pct * 10 + 0.5) AS DOUBLE) / 10 AS chg_pct
        FROM comp LEFT JOIN top USING (rk, y) LEFT JOIN chg USING (rk, y)"""
    ),
    "overview_trends_summary": _q(
        f""", g AS (SELECT y, count(*) FILTER (WHERE g = 'F') AS f, count(*) AS known FROM slim WHERE g IS NOT NULL AND y < 1998 GROUP BY 1 HAVING count(*) >= 30),
        a AS (SELECT y, ag, CAST(round_even(100 * n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE), 0) AS BIGINT) AS pct FROM (SELECT y, ag, count(*) AS n FROM slim WHERE ag IS NOT NULL AND y < 1998 GROUP BY 1, 2)),
        e AS (SELECT min(y) AS from_y, max(y) AS to_y FROM a HAVING min(y) < max(y)),
        b(nr, band) AS (VALUES (0, 'U19'), (1, '19-29'), (2, '30-39'), (3, '40-49'), (4, '50-59'), (5, '60+')),
        s AS (SELECT nr, band, from_y, to_y, coalesce(p.pct, 0) AS from_pct, coalesce(q.pct, 0) AS to_pct FROM e CROSS JOIN b LEFT JOIN a p ON p.y = from_y AND p.ag = band LEFT JOIN a q ON q.y = to_y AND q.ag = band)
        SELECT 'women' AS what, CAST(NULL AS STRING) AS band, min(y) AS from_y, max(y) AS to_y, {_UP.format("arg_min(100 * f / CAST(known AS DOUBLE), y)")} AS from_pct, {_UP.format("arg_max(100 * f / CAST(known AS DOUBLE), y)")} AS to_pct FROM g HAVING count(*) > 1
        UNION ALL SELECT * FROM (SELECT 'age_up', band, from_y, to_y, from_pct, to_pct FROM s ORDER BY to_pct - from_pct DESC, nr LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'age_down', band, from_y, to_y, from_pct, to_pct FROM s ORDER BY to_pct - from_pct, nr LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'age_top', band, from_y, to_y, from_pct, to_pct FROM s ORDER BY to_pct DESC, nr LIMIT 1)""",
        _BASE,
        _SLIM,
    ),
    "coverage_known": """
        WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS race, CAST(1995 + p_size % 7 AS BIGINT) AS year FROM part),
        h AS (SELECT DISTINCT replace(p_name, ' ', '') AS k, CAST(1995 + p_partkey % 5 AS BIGINT) AS had FROM part),
        d AS (SELECT race, year, CASE WHEN length(race) % 3 = 0 THEN 'EXCLUDED' ELSE 'BLOCKED' END AS status,
                     length(race) % 3 <> 0 AND EXISTS (SELECT 1 FROM h WHERE had = year AND (contains(k, race) OR contains(race, k))) AS done FROM k)
        SELECT * FROM d WHERE done OR NOT (year = 2001 AND length(race) % 2 = 0)
    """,
    "races_spread": _q("SELECT rk, y, min(t) AS winner, median(t) AS median, count(*) AS n, round(median(t) / CAST(min(t) AS DOUBLE), 6) AS ratio FROM slim WHERE t IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10", _BASE, _SLIM),
    "races_boxes": _q("SELECT ag, min(t) AS min, quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.75) AS q3, max(t) AS max, count(*) AS n FROM slim WHERE ag IS NOT NULL AND t IS NOT NULL GROUP BY 1 HAVING count(*) >= 8", _BASE, _SLIM),
    "races_histogram": _q(
        """, b AS (SELECT t // 600 * 600 AS x0, count(*) AS c FROM slim WHERE t IS NOT NULL GROUP BY 1)
        SELECT x0, x0 + 600 AS x1, coalesce(c, 0) AS count FROM (SELECT unnest(range((SELECT min(x0) FROM b), (SELECT max(x0) FROM b) + 1, 600)) AS x0) LEFT JOIN b USING (x0)""",
        _BASE, _SLIM,
    ),
    "races_facets": _q("SELECT DISTINCT 'year' AS facet, CAST(y AS STRING) AS value FROM slim UNION SELECT 'series', s FROM slim WHERE s IS NOT NULL UNION SELECT 'class', rc FROM slim UNION SELECT 'gender', g FROM slim WHERE g IS NOT NULL UNION SELECT 'age', ag FROM slim WHERE ag IS NOT NULL", _BASE, _SLIM),
    "races_explore": _q(f"SELECT count(*) AS n, count(DISTINCT rk) AS races, min(y) AS y_min, max(y) AS y_max, CASE WHEN count(g) >= 30 THEN {_UP.format('100 * count(*) FILTER (WHERE g = $$F$$) / CAST(count(g) AS DOUBLE)')} END AS women_pct FROM slim WHERE y IN (1997, 1998) AND g = 'F'", _BASE, _SLIM),
    "races_ridgeline": _q(
        """, big AS (SELECT rk, arg_max(bp, (n, label))[51] AS median, max(n) AS finishers FROM bench WHERE cohort = 'all' GROUP BY rk),
        top AS (SELECT rk AS label, median, finishers FROM big ORDER BY finishers DESC, rk LIMIT 8)
        SELECT label, row_number() OVER (ORDER BY median, label) - 1 AS x, round((median - min(median) OVER ()) / CAST(greatest(max(median) OVER () - min(median) OVER (), 1) AS DOUBLE), 4) AS y, median, finishers FROM top""",
        _BASE, _BENCH,
    ),
    "overview_kpi": _q("SELECT count(*) AS records, count(DISTINCT rk) AS races, count(DISTINCT s) AS series, min(y) AS min_year, max(y) AS max_year, count(DISTINCT plat) AS sources FROM slim", _BASE, _SLIM),
    "overview_heat": _q("SELECT mon, y, count(*) AS n FROM slim GROUP BY 1, 2", _BASE, _SLIM),
    "overview_trend": _q(
        """, top AS (SELECT coalesce(s, '其他') AS k FROM slim GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 3)
        SELECT coalesce(k, '其他') AS s, y, count(*) AS n FROM slim LEFT JOIN top ON coalesce(s, '其他') = k GROUP BY 1, 2""",
        _BASE, _SLIM,
    ),
    "overview_women": _q("SELECT coalesce(s, '其他') AS series, count(*) FILTER (WHERE g = 'F') AS f, count(*) AS total, CAST(round_even(100 * count(*) FILTER (WHERE g = 'F') / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS pct FROM slim WHERE g IS NOT NULL GROUP BY 1 HAVING count(*) >= 50", _BASE, _SLIM),
    "overview_composition": _q("SELECT rc, count(*) FILTER (WHERE g = 'M') AS male, count(*) FILTER (WHERE g = 'F') AS female, count(*) FILTER (WHERE g IS NULL) AS unknown FROM slim GROUP BY 1", _BASE, _SLIM),
    "overview_gender_trend": _q("SELECT y, count(*) FILTER (WHERE g = 'F') AS f, count(*) AS known FROM slim WHERE g IS NOT NULL GROUP BY 1", _BASE, _SLIM),
    "overview_age_trend": _q("SELECT y, ag, n, CAST(round_even(100 * n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE), 0) AS BIGINT) AS pct FROM (SELECT y, ag, count(*) AS n FROM slim WHERE ag IS NOT NULL GROUP BY 1, 2)", _BASE, _SLIM),
    "overview_sources": _q("SELECT plat, count(*) AS n FROM slim GROUP BY 1", _BASE, _SLIM),
    "teams_index": _q("SELECT substr(sha1('podia-team-v1|' || team), 1, 10) AS id, team AS name, count(DISTINCT gk) AS riders, count(*) AS rows, count(DISTINCT race_key) AS races, count(*) FILTER (WHERE rank_overall = 1) AS wins, count(*) FILTER (WHERE rank_overall <= 3) AS podiums, min(rank_overall) AS best, min(year) AS y0, max(year) AS y1 FROM squad GROUP BY team", _KEYED, _TEAMS),
    "teams_roster": _q(
        """SELECT team, id, nm, n, best, y0, y1, link, row_number() OVER (PARTITION BY team ORDER BY n DESC, coalesce(best, 9999), id) AS place FROM (
          SELECT team, id, arg_min(name_masked, row_ord) AS nm, count(*) AS n, min(rank_overall) AS best, min(year) AS y0, max(year) AS y1, max(gn) >= 2 AS link FROM squad GROUP BY team, id)""",
        _KEYED, _TEAMS,
    ),
    "teams_by_year": _q("SELECT team, year AS y, count(DISTINCT gk) AS riders, count(DISTINCT race_key) AS races FROM squad GROUP BY 1, 2", _KEYED, _TEAMS),
    "teams_highlights": _q("SELECT team, place, id, rk, y, rank, CAST(round_even(pct, 0) AS BIGINT) AS pct FROM (SELECT team, row_number() OVER (PARTITION BY team ORDER BY pct DESC, row_ord) AS place, id, race_key AS rk, year AS y, rank_overall AS rank, pct FROM squad WHERE pct IS NOT NULL) WHERE place <= 10", _KEYED, _TEAMS),
    "series_stations": _q("SELECT series AS s, year AS y, race_key AS rk, arg_min(race_name_canonical, row_ord) AS name, max(field) AS n FROM full_rows WHERE series IS NOT NULL GROUP BY 1, 2, 3", _KEYED),
    "series_standings": _q(
        """, best AS (SELECT series AS s, year AS y, id, gn, race_key, max(pct) AS p, min((row_ord, name_masked)) AS fst FROM full_rows WHERE series IS NOT NULL AND pct IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
        total AS (SELECT s, y, id, gn >= 2 AS link, round(sum(p), 6) AS pts, count(*) AS n, max(p) AS best, arg_min(fst[2], fst[1]) AS nm FROM best GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
        SELECT s, y, place, id, nm, CAST(round_even(pts, 0) AS BIGINT) AS pts, n, CAST(round_even(best, 0) AS BIGINT) AS best, link FROM (SELECT *, row_number() OVER (PARTITION BY s, y ORDER BY pts DESC, n DESC, id) AS place FROM total) WHERE place <= 50""",
        _KEYED,
    ),
    "insights_age_curve": _q(
        """SELECT band, g, count(*) AS n, round(quantile_cont(pct, 0.25), 1) AS p25, round(quantile_cont(pct, 0.5), 1) AS p50, round(quantile_cont(pct, 0.75), 1) AS p75 FROM (
          SELECT age_band AS band, 'all' AS g, pct FROM scored WHERE pct IS NOT NULL AND age_band IS NOT NULL UNION ALL SELECT age_band, gender, pct FROM scored WHERE pct IS NOT NULL AND age_band IS NOT NULL AND gender IS NOT NULL)
        GROUP BY 1, 2 HAVING count(*) >= 50""",
        _KEYED,
    ),
    "insights_breakout": _q(
        """, yearly AS (SELECT id, year AS y, median(pct) AS m FROM scored WHERE pct IS NOT NULL AND gk IN (SELECT gk FROM gsize WHERE gn >= 2) GROUP BY 1, 2 HAVING count(*) >= 2),
        steps AS (SELECT id, lag(y) OVER w AS from_y, y AS to_y, lag(m) OVER w AS a, m AS b FROM yearly WINDOW w AS (PARTITION BY id ORDER BY y)),
        best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(b - a, 9) DESC, to_y) AS k FROM steps WHERE from_y IS NOT NULL)
        SELECT id, from_y, to_y, round(a, 1) AS from_pct, round(b, 1) AS to_pct, round(b - a, 1) AS jump FROM best WHERE k = 1 AND round(b - a, 1) >= 5 ORDER BY jump DESC, id LIMIT 40""",
        _KEYED,
    ),
    "insights_geo": _q(
        """SELECT CASE WHEN regexp_matches(race_key, 'Brand#1') THEN 'North' WHEN regexp_matches(race_key, 'Brand#2[0-4]') THEN 'South' WHEN regexp_matches(race_key, '#5|#9') THEN 'Centre' ELSE region END AS region,
           count(DISTINCT race_key) AS races, count(*) AS rows FROM results GROUP BY 1"""
    ),
    "insights_ratings": _q(
        """, reg AS (SELECT name_raw FROM results GROUP BY 1 HAVING count(DISTINCT race_key) >= 3),
        per AS (SELECT race_key, count(*) AS f, count(*) FILTER (WHERE name_raw IN (SELECT name_raw FROM reg)) AS r, count(DISTINCT year) AS editions, arg_max(race_name_canonical, row_ord) AS name, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM results GROUP BY 1),
        med AS (SELECT rk AS race_key, CAST(floor(median(field)) AS BIGINT) AS med_field FROM ranked_fields GROUP BY 1 HAVING floor(median(field)) >= 20),
        rated AS (SELECT race_key, name, years, med_field, editions, round(r / CAST(f AS DOUBLE) * 100, 1) AS regular_pct FROM per JOIN med USING (race_key)),
        sc AS (SELECT *, CAST(round_even((0.4::DOUBLE * least(log10(med_field) / log10(2500), 1.0::DOUBLE) + 0.25::DOUBLE * least(editions / 8.0::DOUBLE, 1.0::DOUBLE) + 0.35::DOUBLE * least(regular_pct / 40, 1.0::DOUBLE)) * 100, 0) AS BIGINT) AS score FROM rated),
        q AS (SELECT *, (row_number() OVER (ORDER BY score DESC, race_key) - 1) / CAST(count(*) OVER () AS DOUBLE) AS q FROM sc)
        SELECT race_key, name, score, med_field, editions, regular_pct, years, CAST(CASE WHEN q < 0.1 THEN 5 WHEN q < 0.3 THEN 4 WHEN q < 0.6 THEN 3 WHEN q < 0.85 THEN 2 ELSE 1 END AS BIGINT) AS stars FROM q ORDER BY score DESC, race_key LIMIT 60""",
        _KEYED,
    ),
    "insights_biggest_fields": _q("SELECT rk, rk AS name, y, field AS n FROM ranked_fields ORDER BY field DESC, rk, y LIMIT 8", _KEYED),
    "open_dataset": _q(
        """SELECT race_key, year, date, region, series, race_name_canonical, CAST(NULL AS STRING) AS race_type, race_class, result_label, category_raw, gender, age_band, CAST(NULL AS STRING) AS age_group,
           rank_overall, finish_seconds, CAST(NULL AS STRING) AS finish_time, team, name_masked, source_platform FROM results"""
    ),
    "manifest": _q(
        """SELECT (SELECT count(*) FROM slim) AS records, (SELECT count(DISTINCT rk) FROM slim) AS races, (SELECT count(DISTINCT s) FROM slim) AS series, (SELECT count(DISTINCT plat) FROM slim) AS sources,
           (SELECT min(y) FROM slim) AS year_min, (SELECT max(y) FROM slim) AS year_max, (SELECT count(*) FROM fields) AS race_editions, (SELECT count(*) FROM gsize WHERE gn >= 2) AS athletes, (SELECT count(*) FROM real) AS teams,
           'races,leaderboard,crossyear,athletes,history,rivals,climbs,course_records,teams,series,race_dna,difficulty,benchmarks,insights,overview,coverage,dataset' AS endpoints""",
        _KEYED, _SLIM, _TEAMS,
    ),
}

_CAREER = """,
runs AS (SELECT gk, y - row_number() OVER (PARTITION BY gk ORDER BY y) AS run FROM (SELECT DISTINCT gk, year AS y FROM track)),
streak AS (SELECT gk, max(n) AS streak FROM (SELECT gk, run, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY gk),
loyal AS (SELECT gk, arg_min(race_key, (-n, race_key)) AS lrk, max(n) AS lyears FROM (SELECT gk, race_key, count(DISTINCT year) AS n FROM track GROUP BY 1, 2) GROUP BY gk),
career AS (
  SELECT t.id, any_value(a.nm) AS nm, CASE WHEN count(*) FILTER (WHERE gender = 'M') > count(*) FILTER (WHERE gender = 'F') THEN 'M' WHEN count(*) FILTER (WHERE gender = 'M') < count(*) FILTER (WHERE gender = 'F') THEN 'F' END AS g,
         any_value(lrk) AS lname, count(*) AS n, count(*) FILTER (WHERE rank_overall = 1) AS wins, count(DISTINCT race_key) AS nr, any_value(streak) AS streak, any_value(lrk) AS lrk, any_value(lyears) AS lyears
  FROM track t JOIN athletes a ON t.id = a.id AND a.conf <> 'low' JOIN streak USING (gk) JOIN loyal USING (gk) GROUP BY t.id
)"""
ORACLE["insights_careers"] = _q("SELECT * FROM career", _KEYED, _INDEX, _CAREER)
ORACLE["insights_boards"] = _q(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS board, row_number() OVER (ORDER BY {col} DESC, id) AS place, id, nm, g, {"lrk" if col == "lyears" else "NULL"} AS rk, {"lname" if col == "lyears" else "NULL"} AS name, {col} AS v FROM career WHERE {col} > {above} QUALIFY place <= 8"
        for name, col, above in (("most_starts", "n", 0), ("most_wins", "wins", 0), ("most_races", "nr", 0), ("longest_streak", "streak", 0), ("most_loyal", "lyears", 1))
    )
    + ")",
    _KEYED, _INDEX, _CAREER,
)
ORACLE["course_records_women"] = f"SELECT * REPLACE (row_number() OVER (PARTITION BY rk ORDER BY rank) AS rank) FROM ({ORACLE['course_records']}) WHERE g = 'F'"

_PRINTS = """,
kinds AS (
  SELECT *, CASE WHEN race_name_raw LIKE '%hot%' THEN 'climb' WHEN race_name_raw LIKE '%ring%' THEN 'flat' WHEN race_name_raw LIKE '%red%' THEN 'tt' ELSE 'flat' END AS kind FROM track
),
per AS (
  SELECT gk, id, median(pct) AS overall, median(pct) FILTER (WHERE kind = 'climb') AS climb, median(pct) FILTER (WHERE kind = 'flat') AS flat, median(pct) FILTER (WHERE kind = 'tt') AS tt,
         CASE WHEN count(*) FILTER (WHERE gender = 'M') > count(*) FILTER (WHERE gender = 'F') THEN 'M' WHEN count(*) FILTER (WHERE gender = 'F') > count(*) FILTER (WHERE gender = 'M') THEN 'F' END AS g
  FROM kinds GROUP BY gk, id HAVING count(pct) >= 2
),
bands AS (SELECT gk, arg_min(age_band, (-n, f)) AS band FROM (SELECT gk, age_band, count(*) AS n, min(row_ord) AS f FROM track WHERE age_band IS NOT NULL GROUP BY 1, 2) GROUP BY gk),
pool AS (
  SELECT per.*, CASE band WHEN 'U19' THEN 17 WHEN '19-29' THEN 24 WHEN '30-39' THEN 34 WHEN '40-49' THEN 44 WHEN '50-59' THEN 54 WHEN '60+' THEN 64 END::DOUBLE AS age
  FROM per LEFT JOIN bands USING (gk) WHERE g IS NOT NULL
),
z AS (
  SELECT id, g, (climb - avg(climb) OVER w) / nullif(stddev_pop(climb) OVER w, 0) AS climb, (flat - avg(flat) OVER w) / nullif(stddev_pop(flat) OVER w, 0) AS flat,
         (tt - avg(tt) OVER w) / nullif(stddev_pop(tt) OVER w, 0) AS tt, (overall - avg(overall) OVER w) / nullif(stddev_pop(overall) OVER w, 0) AS overall,
         (age - avg(age) OVER w) / nullif(stddev_pop(age) OVER w, 0) AS age
  FROM pool WINDOW w AS (PARTITION BY g)
),
prints AS (
  SELECT id, g, round(coalesce(climb, overall), 2) + 0.0 AS climb, round(coalesce(flat, overall), 2) + 0.0 AS flat, round(coalesce(tt, overall), 2) + 0.0 AS tt, round(overall, 2) + 0.0 AS overall, round(coalesce(age, 0), 2) + 0.0 AS age FROM z
)"""
ORACLE["athletes_features"] = _q("SELECT * FROM prints", _KEYED, _PRINTS)
ORACLE["athletes_doppelgangers"] = _q(
    """, me AS (SELECT * FROM prints ORDER BY id LIMIT 1),
    near AS (SELECT p.id, sqrt(power(p.climb - me.climb, 2) + power(p.flat - me.flat, 2) + 0.8::DOUBLE * power(p.tt - me.tt, 2) + 1.3::DOUBLE * power(p.overall - me.overall, 2) + 0.5::DOUBLE * power(p.age - me.age, 2)) AS dist
             FROM prints p JOIN me ON p.g = me.g AND p.id <> me.id)
    SELECT id, round(dist, 6) AS dist, CAST(round(100 * exp(-dist / 2.5)) AS BIGINT) AS sim FROM near ORDER BY near.dist, id LIMIT 6""",
    _KEYED, _PRINTS,
)


def _percentile(axis: str) -> str:
    place = f"row_number() OVER (PARTITION BY {axis} IS NULL ORDER BY round({axis}, 9), rk, y) - 1"
    n = f"count(*) OVER (PARTITION BY {axis} IS NULL)"
    return f"CAST(round_even(CASE WHEN {axis} IS NULL OR {n} = 1 THEN 50 ELSE ({place}) / CAST({n} - 1 AS DOUBLE) * 100 END, 0) AS BIGINT) AS {axis}"


_DNA = f""",
ridden AS (SELECT DISTINCT gk, race_key AS rk, year AS y FROM keyed WHERE gk NOT IN ('n:', 'u:', 't:')),
habits AS (SELECT rk, y, count(*) AS riders, count(*) FILTER (WHERE here > 1) AS again, count(*) FILTER (WHERE editions >= 3) AS regular
           FROM (SELECT *, count(*) OVER (PARTITION BY gk) AS editions, count(*) OVER (PARTITION BY gk, rk) AS here FROM ridden) GROUP BY 1, 2),
spread AS (SELECT rk, y, sum(cov * c) / sum(c) AS sel FROM (SELECT race_key AS rk, year AS y, result_label, count(*) AS c, stddev_pop(finish_seconds) / avg(finish_seconds) AS cov
           FROM keyed WHERE finish_seconds > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 10) GROUP BY 1, 2),
traits AS (
  SELECT k.*, sel, CAST(NULL AS DOUBLE) AS climb, n::DOUBLE AS size, regular / CAST(riders AS DOUBLE) * 100 AS prest, again / CAST(riders AS DOUBLE) * 100 AS repeat, CASE WHEN gn / CAST(n AS DOUBLE) >= 0.3 THEN f / CAST(gn AS DOUBLE) * 100 END AS women
  FROM (SELECT race_key AS rk, year AS y, count(*) AS n, count(gender) AS gn, count(*) FILTER (WHERE gender = 'F') AS f FROM keyed GROUP BY 1, 2 HAVING count(*) >= 20) k
  LEFT JOIN habits USING (rk, y) LEFT JOIN spread USING (rk, y)
),
dna AS (SELECT rk, y, n, {", ".join(_percentile(a) for a in ("sel", "size", "climb", "prest", "repeat", "women"))} FROM traits)"""
ORACLE["races_dna"] = _q("SELECT * FROM dna", _KEYED, _DNA)
ORACLE["races_similar"] = _q(
    """, me AS (SELECT * FROM dna WHERE rk = 'Brand#7' AND y = 1998),
    sims AS (SELECT d.rk, d.y, CAST(round(100 * exp(-sqrt(power(d.sel - me.sel, 2) + power(d.size - me.size, 2) + power(d.climb - me.climb, 2) + power(d.prest - me.prest, 2) + power(d.repeat - me.repeat, 2) + power(d.women - me.women, 2)) / 90)) AS BIGINT) AS sim
             FROM dna d JOIN me ON d.rk <> me.rk)
    SELECT rk, y, sim FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY sim DESC, y) AS k FROM sims) WHERE k = 1 ORDER BY sim DESC, rk LIMIT 5""",
    _KEYED, _DNA,
)
_BEAT = "CAST(round_even(length(list_filter(bp, lambda t: t > {0})) / 101.0::DOUBLE * 100, 0) AS BIGINT) AS percentile_beat"
ORACLE["races_benchmark_lookup"] = _q(
    f"""SELECT * FROM (SELECT rk, label, cohort, n, {_BEAT.format(30000)} FROM bench WHERE rk = 'Brand#7' AND cohort IN ('age:30-39|g:M', 'age:30-39', 'all')
      ORDER BY label <> 'PROMO', max(CASE WHEN cohort = 'all' THEN n END) OVER (PARTITION BY label) DESC, label, length(cohort) DESC LIMIT 1)
    UNION ALL SELECT * FROM (SELECT rk, label, cohort, n, {_BEAT.format(9000)} FROM bench WHERE rk = 'Brand#7' AND cohort = 'all' ORDER BY n DESC, label LIMIT 1)""",
    _BASE, _BENCH,
)
ORACLE["merge_cross_listed"] = _q(
    """, own AS (SELECT race_key, year, race_key || '|' || result_label AS t, name_raw AS nm, CAST(floor(finish_seconds) AS BIGINT) AS s, rank_overall AS r FROM results WHERE finish_seconds > 0 AND (status IS NULL OR status = 'FIN')),
    every AS (SELECT DISTINCT race_key, year, t, nm, s FROM own UNION SELECT 'Brand#3b', year, t || 'b', nm, s FROM own WHERE race_key = 'Brand#3' AND r > 1),
    sizes AS (SELECT race_key, year, t, count(*) AS n FROM every GROUP BY 1, 2, 3),
    shared AS (SELECT a.year, a.t AS a, b.t AS b, count(*) AS k FROM every a JOIN every b ON a.year = b.year AND a.nm = b.nm AND a.s = b.s AND a.t <> b.t GROUP BY 1, 2, 3)
    SELECT DISTINCT CAST(0 AS BIGINT) AS source_ord, k.year, k.a AS table_id FROM shared k JOIN sizes x ON x.t = k.a AND x.year = k.year JOIN sizes y ON y.t = k.b AND y.year = k.year
    WHERE x.n >= 10 AND x.race_key <> y.race_key AND y.n > x.n AND k.k >= 0.95 * x.n""",
    _BASE,
)
ORACLE["text_books"] = f"""
        WITH {_BASE}, {_ENTRANTS}
        SELECT book, category, CAST(section * 10 + 50 AS VARCHAR) || '公里個人公路賽' AS event, CASE WHEN section = 0 THEN 'F' ELSE 'M' END AS gender,
               bib, name, CASE WHEN t IS NOT NULL THEN n END AS rank, CASE WHEN t IS NOT NULL AND (layout = 0 OR layout = 2 AND n >= 1000) THEN licence END AS uci_id,
               team, CASE WHEN t IS NOT NULL THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) END AS finish_time,
               CAST(t AS DOUBLE) AS finish_seconds, CASE WHEN t IS NULL THEN status END AS status
        FROM entrants QUALIFY row_number() OVER (PARTITION BY book, section, bib, name ORDER BY n) = 1
    """
ORACLE["text_books_refused"] = f"""
        WITH {_BASE}, {_ENTRANTS}, s AS (SELECT book, count(DISTINCT section) AS k FROM entrants GROUP BY book)
        SELECT book, 'page skipped' AS refused, 3 * k AS lines FROM s UNION ALL SELECT book, 'no rider', 4 * k FROM s
    """
ORACLE["page_tables"] = r"""
        WITH items AS (
            SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS link, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS raw,
                   unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>')))) AS i
            FROM pages
        ),
        t AS (
            SELECT page_id, CAST(i AS INTEGER) AS i, regexp_replace(trim(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), ' +', ' ', 'g') AS text,
                   replace(link, '&amp;', '&') AS link
            FROM items
        ),
        p AS (SELECT DISTINCT page_id FROM t)
        SELECT page_id, 'raw' AS kind, 0 AS "table", i AS line, false AS header, text AS cells, '' AS heads, link AS links FROM t
        UNION ALL SELECT page_id, 'made', 0, i + 2, false, page_id || ' end|' || text || '|' || link, 'Page|Text|Link', '' FROM t
        UNION ALL SELECT page_id, 'made', 0, 0, true, 'Page|Item|Item', '', '' FROM p
        UNION ALL SELECT page_id, 'made', 0, 1, true, 'Page|Text|Link', 'Page|Item|Item', '' FROM p
        UNION ALL SELECT page_id, 'made', 1, 0, false, 'inner', '', '' FROM p
    """
ORACLE["calendar_pages"] = """
        SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate - INTERVAL 6 MONTH) AS VARCHAR) AS page,
               CASE o_custkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'lines' ELSE 'table' END AS layout,
               'Order ' || CAST(o_orderkey AS VARCHAR) || ' 挑戰賽' AS race, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date
        FROM orders
    """
_CHARS = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘成歲律呂調陽雲騰致雨露結為霜"


def _gaps(name: str, of: str) -> str:
    """Tables name (race, date, best, years_known, status) of the parts `of` as a calendar."""

    def made(shift: str) -> str:
        return " || ".join(f"substr('{_CHARS}', CAST((p_partkey * {a} + {b} + {shift}) % {len(_CHARS)} + 1 AS BIGINT), 1)" for a, b in ((7, 0), (11, 3), (13, 5), (17, 1))) + " || '自行車賽'"

    return f"""
    {name}_cal AS (SELECT race, min(date) AS date, list_distinct(string_split(race, '')) AS x FROM (SELECT {made("0")} AS race, '1998-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS date FROM part WHERE {of}) GROUP BY race),
    {name}_known AS (SELECT race AS k, list(DISTINCT year) AS years, list_distinct(string_split(race, '')) AS y FROM (SELECT {made("p_partkey % 3")} AS race, 1993 + p_partkey % 6 AS year FROM part WHERE p_size < 4) GROUP BY race),
    {name}_pairs AS (SELECT race, k, years, len(list_intersect(x, y)) / CAST(least(len(x), len(y)) AS DOUBLE) AS s FROM {name}_cal, {name}_known WHERE len(list_intersect(x, y)) >= 0.6 * least(len(x), len(y)) - 0.000000001),
    {name}_best AS (SELECT race, max(s) AS best FROM {name}_pairs GROUP BY race),
    {name}_near AS (SELECT p.race, best, list_distinct(flatten(list(years))) AS years FROM {name}_pairs p JOIN {name}_best b ON p.race = b.race AND p.s = b.best GROUP BY 1, 2),
    {name} AS (
      SELECT race, date, best, years_known, status FROM (
        SELECT c.race, date, round(best, 6) AS best, CAST(len(years) AS BIGINT) AS years_known,
               CASE WHEN best IS NULL THEN 'UNKNOWN' WHEN date < '1998-06-30' AND NOT list_contains(years, 1998) THEN 'NOT_INGESTED' END AS status
        FROM {name}_cal c LEFT JOIN {name}_near n ON c.race = n.race)
      WHERE status IS NOT NULL
    )"""


_VERDICT = """CASE WHEN contains(race, '玄') THEN ['BLOCKED', 'closed site'] WHEN contains(race, '宙') THEN ['NOT_HELD', 'not yet'] WHEN contains(race, '洪') THEN ['COLLECTED', 'another name']
             WHEN contains(race, '日') THEN ['NO_RANKING', 'a ride'] WHEN contains(race, '月') THEN ['HELD_UNCHECKED', 'to be looked at'] END"""
_TOLD = f"""{_gaps("gap", "p_size > 44")},
    told AS (
      SELECT race, date, best, years_known, coalesce(v[1], status) AS status, v[2] AS note FROM (SELECT *, {_VERDICT} AS v FROM gap)
      WHERE v IS NULL OR NOT (v[1] = 'COLLECTED' OR status = 'NOT_INGESTED' AND v[1] = 'NO_RANKING')
    )"""
ORACLE["coverage_gaps"] = f"WITH {_TOLD} SELECT * FROM told"
ORACLE["season_board"] = f"""
    WITH {_BASE}, {_TOLD}, {_gaps("old", "p_size BETWEEN 43 AND 44")},
    wanted AS (
      SELECT race, date, status FROM told
      UNION ALL SELECT race, date, v[1] FROM (SELECT *, {_VERDICT} AS v FROM old) WHERE v IS NULL OR v[1] <> 'COLLECTED'
    )
    SELECT race_key AS name, min(date) AS date, 'ok' AS status, count(*) FILTER (WHERE status IS NULL OR status = 'FIN') AS rows FROM results WHERE year = 1998 GROUP BY race_key
    UNION ALL
    SELECT race, date, CASE WHEN status IN ('NOT_INGESTED', 'HELD_UNCHECKED') THEN CASE WHEN date >= '1998-06-30' THEN 'soon' ELSE 'wait' END
                            WHEN status = 'NOT_HELD' THEN CASE WHEN date < '1998-06-30' THEN 'wait' ELSE 'soon' END ELSE 'miss' END, NULL
    FROM wanted WHERE status IN ('NOT_INGESTED', 'HELD_UNCHECKED', 'BLOCKED', 'NOT_HELD')
"""
ORACLE["quality_samples"] = _q(
    """, r AS (SELECT source_ord, row_ord, unnest(list_filter([CASE WHEN finish_seconds IS NULL AND row_ord % 50 <> 0 THEN 'missing_time' END, CASE WHEN row_ord % 41 = 0 THEN 'missing_name' END,
                 CASE WHEN row_ord % 77 = 0 THEN 'missing_race' END, CASE WHEN row_ord % 50 = 0 THEN 'time_out_of_range' END, CASE WHEN row_ord % 90 = 0 THEN 'year_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM results)
    SELECT issue, CAST(row_number() OVER (PARTITION BY issue ORDER BY source_ord, row_ord) AS INTEGER) AS place, source_ord, row_ord FROM r QUALIFY place <= 5""",
    _BASE,
)
_WORD = r"[A-Za-zÀ-ÿ''’.\-]+"
ORACLE["quality_exposed_names"] = f"""
    WITH n AS (
      SELECT DISTINCT replace(lower(array_to_string(list_slice(regexp_extract_all(text, '{_WORD}'), 1, item_id % 2 + 2), ' ')), 'ß', 'ss') AS key FROM benchmark
      WHERE len(list_slice(regexp_extract_all(text, '{_WORD}'), 1, item_id % 2 + 2)) >= 2
    ),
    l AS (SELECT doc_id, regexp_extract_all(unnest(regexp_split_to_array(text, '[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')), '{_WORD}') AS w FROM documents),
    g AS (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM l, (SELECT unnest([2, 3, 4]) AS k))
    SELECT doc_id, key, count(*) AS hits FROM (SELECT doc_id, replace(lower(array_to_string(w[i:i + k - 1], ' ')), 'ß', 'ss') AS key FROM g) JOIN n USING (key) GROUP BY 1, 2
"""
ORACLE["identity_carryover"] = _q(
    """, old AS (SELECT race_key || '|' || CAST(year AS VARCHAR) || '|' || CAST(CAST(finish_seconds AS BIGINT) AS VARCHAR) || '|' || name_masked AS entry, substr(sha1('podia-athlete-v1|n:' || name_raw), 1, 10) AS old_id, * FROM keyed),
    published AS (SELECT entry, old_id FROM old WHERE entry IS NOT NULL),
    sure AS (SELECT entry, min(old_id) AS old_id FROM published GROUP BY entry HAVING count(DISTINCT old_id) = 1),
    fresh AS (SELECT id, entry, row(source_ord, row_ord) AS spot FROM old WHERE id NOT IN (SELECT old_id FROM published)),
    votes AS (SELECT id, old_id, count(*) AS n, min(spot) AS seen FROM fresh JOIN sure USING (entry) GROUP BY 1, 2),
    best AS (SELECT id, old_id FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, seen) = 1),
    place AS (SELECT id, min(spot) AS first FROM fresh GROUP BY id)
    SELECT id AS new_id, old_id FROM best JOIN place USING (id) WHERE old_id NOT IN (SELECT id FROM keyed) QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY first) = 1""",
    _KEYED,
)
ORACLE["increment_changed"] = _q(
    """SELECT DISTINCT race_key, year, CASE WHEN race_key = 'Brand#2' THEN 'missing' ELSE 'changed' END AS state FROM results
    WHERE race_key = 'Brand#2' AND year = 1996 OR race_key = 'Brand#4' AND bib = 3 AND finish_seconds IS NOT NULL"""
)
ORACLE["increment_counts"] = _q(
    """, n AS (SELECT year AS y, gender AS g, floor(finish_seconds + CASE WHEN race_key = 'Brand#4' AND bib = 3 THEN 1 ELSE 0 END) AS t FROM results
            WHERE (status IS NULL OR status = 'FIN') AND NOT (race_key = 'Brand#2' AND year = 1996))
    SELECT y, g, count(*) AS n, round(avg(t), 6) AS mean FROM n GROUP BY 1, 2""",
    _BASE,
)
_NAMED = " || ".join(f"substr('{_CHARS}', CAST((b * {x} + {y}) % {len(_CHARS)} + 1 AS BIGINT), 1)" for x, y in ((7, 0), (11, 3), (13, 5), (17, 1)))
ORACLE["merge_candidates"] = f"""
    WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS b, p_size % 4 AS kind FROM part),
    k AS (
      SELECT *, CASE WHEN b % 3 = 0 THEN kind WHEN b % 3 = 1 THEN CASE WHEN kind > 1 THEN 3 ELSE kind END ELSE CASE WHEN kind > 0 THEN 1 ELSE 0 END END AS own, {_NAMED} AS base FROM p
    ),
    m AS (
      SELECT p_brand || '|' || own AS rk, b, base, own, (2010 + b % 9) || ' ' || base || '自行車賽' || CASE own WHEN 0 THEN '' WHEN 1 THEN '挑戰組' WHEN 2 THEN '東部段' ELSE '第3屆' END AS name,
             count(*) AS rows, array_to_string(list_sort(list(DISTINCT 1992 + p_partkey % 5)), '+') AS years
      FROM k GROUP BY ALL
    ),
    c AS (
      SELECT *, base || '賽' AS loose, base || '賽' || CASE own WHEN 1 THEN '組' WHEN 2 THEN '東部段' ELSE '' END AS safe FROM m
    )
    SELECT loose, CASE WHEN count(DISTINCT safe) > 1 AND bool_or(own = 2) THEN 'REJECT' WHEN count(DISTINCT safe) = 1 THEN 'SAFE' ELSE 'REVIEW' END AS verdict,
           array_to_string(list_sort(list(DISTINCT safe)), ',') AS safe_cores, string_agg(rk || '/' || name || '/' || rows || '/' || years, ',' ORDER BY rows DESC, rk) AS members, CAST(sum(rows) AS BIGINT) AS total_rows
    FROM c GROUP BY loose HAVING count(*) >= 2
"""
ORACLE["fn_series"] = """
    SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '台灣登山大滿貫(雪巴)' WHEN 1 THEN '96聯賽' WHEN 2 THEN 'TIS崇越盃系列' WHEN 3 THEN 'L''Étape 環法日月潭'
           WHEN 4 THEN '臺灣自行車聯賽(TCL)' WHEN 5 THEN 'GravelFundo 礫石越野系列' WHEN 7 THEN '環花東國際自行車賽' END AS series FROM part
"""
ORACLE["merge_superseded"] = _q(
    "SELECT source_platform, count(*) AS rows FROM results WHERE NOT (source_platform = '1-URGENT' AND race_key = 'Brand#1') AND NOT (source_platform = '2-HIGH' AND race_key = 'Brand#7' AND year = 1995) GROUP BY 1"
)
ORACLE["identity_legacy"] = _q(
    """, published AS (SELECT race_key || '|' || CAST(year AS VARCHAR) || '|' || CAST(CAST(finish_seconds AS BIGINT) AS VARCHAR) || '|' || name_masked AS entry, min(id) AS aid FROM keyed WHERE finish_seconds IS NOT NULL GROUP BY 1),
    hid AS (SELECT * REPLACE (CASE WHEN row_ord % 4 = 0 THEN substr(name_raw, 1, 1) || '*' ELSE name_raw END AS name_raw), row_ord % 4 = 0 AS hidden,
                   race_key || '|' || CAST(year AS VARCHAR) || '|' || CAST(CAST(finish_seconds AS BIGINT) AS VARCHAR) || '|' || name_masked AS entry FROM results),
    anchor2 AS (SELECT name_raw AS nm, CASE WHEN count(DISTINCT tsu_rider_id) = 1 THEN min(tsu_rider_id) END AS tsu, CASE WHEN count(DISTINCT uci_id) = 1 THEN min(uci_id) END AS uci FROM hid GROUP BY 1),
    open AS (SELECT h.*, CASE WHEN tsu_rider_id IS NOT NULL THEN 't:' || tsu_rider_id WHEN uci_id IS NOT NULL THEN 'u:' || uci_id WHEN tsu IS NOT NULL THEN 't:' || tsu WHEN uci IS NOT NULL THEN 'u:' || uci ELSE 'n:' || name_raw END AS gk
             FROM hid h LEFT JOIN anchor2 a ON h.name_raw = a.nm),
    held AS (SELECT substr(sha1('podia-athlete-v1|' || gk), 1, 10) AS aid, arg_min(gk, row_ord) AS held_key FROM open WHERE NOT hidden GROUP BY 1)
    SELECT row_ord, CASE WHEN NOT hidden THEN gk WHEN p.aid IS NULL THEN 's:' || CAST(row_ord AS VARCHAR) ELSE coalesce(held_key, 'x:' || p.aid) END AS gk
    FROM open o LEFT JOIN published p ON o.hidden AND o.entry = p.entry LEFT JOIN held h ON p.aid = h.aid""",
    _KEYED,
)
ORACLE["series_documents"] = f"SELECT s, y, string_agg(rk || '/' || CAST(n AS VARCHAR), ',' ORDER BY rk) AS stations FROM ({ORACLE['series_stations']}) GROUP BY s, y"
ORACLE["json_sources"] = _q(
    """SELECT CAST(substr(source_platform, 1, 1) AS BIGINT) - 1 AS source_ord, name_raw AS name, CASE WHEN race_key = 'Brand#1' THEN 'Brand#One' ELSE race_key END AS race_key, year, finish_seconds, name_masked
    FROM results WHERE substr(source_platform, 1, 1) IN ('1', '2')"""
)
