"""Parts of SQL, and of inputs, that several queries share. Regular expressions and literals are as the comparing engine writes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import timeline
from strandline.plans.inputs import read

# Regular expressions and literals as the comparing engine writes them.
ALPHABET = r"0-9a-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}"

KEY = lambda c: f"regexp_replace(lower({c}), '[^{ALPHABET}]+', '', 'g')"

STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

STAMP = r"'^\[(\d{1,2}):(\d{2})(?:[.:](\d{1,3}))?\]\s*(.*)'"

LINES = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '')"

MERGE = """
    g AS (SELECT job_id, greatest(0e0, s - 0.12e0) AS s, least(duration, e + 0.2e0) AS e FROM s
        WHERE least(duration, e + 0.2e0) - greatest(0e0, s - 0.12e0) >= 0.35e0),
    h AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.75e0 THEN 0
        ELSE 1 END AS new FROM g),
    k AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM h),
    iv AS (SELECT job_id, cast(run - 1 AS int) AS idx, min(s) AS s, max(e) AS e FROM k GROUP BY job_id, run)"""

SPELLS = 's AS (SELECT job_id, duration, start AS s, "end" AS e FROM {spells}),'

LRC = f"""
    l AS (SELECT job_id, duration, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM {{lyrics}}),
    v AS (SELECT *, regexp_extract({STRIP('raw')}, {STAMP}, 1) AS mm, regexp_extract({STRIP('raw')}, {STAMP}, 2) AS ss, regexp_extract({STRIP('raw')},
        {STAMP}, 3) AS ff,
                 {STRIP(f"regexp_extract({STRIP('raw')}, {STAMP}, 4)")} AS words FROM l WHERE regexp_matches({STRIP('raw')}, {STAMP})),
    t AS (SELECT job_id, duration, line_no, words, cast(mm AS int) * 60 + cast(ss AS int) + CASE WHEN ff = '' THEN 0e0
        ELSE cast(ff AS double) / pow(10e0, length(ff)) END AS t FROM v),
    n AS (SELECT a.job_id, a.line_no, arg_min(b.t, b.line_no) AS next FROM t a JOIN t b ON b.job_id = a.job_id AND b.line_no > a.line_no AND b.t > a.t
        GROUP BY a.job_id, a.line_no),
    items AS (SELECT t.job_id, cast(row_number() OVER (PARTITION BY t.job_id ORDER BY t.line_no) - 1 AS int) AS idx, t AS start, least(duration, CASE
        WHEN next IS NULL THEN t + 3.5e0 ELSE greatest(t + 0.2e0, next - 0.05e0) END) AS "end", words AS text
              FROM t LEFT JOIN n ON n.job_id = t.job_id AND n.line_no = t.line_no WHERE words <> '')"""

CLEAN = r"trim(regexp_replace(j->>'title', '(?i)[(\[{][^)\]}]*\b(?:official|audio|video|lyrics?|mv)\b[^)\]}]*[)\]}]', '', 'g'))"

NAMES = f"""j AS (SELECT job_id, artist, title, cast(payload AS json) AS j FROM {{payloads}}),
    c AS (SELECT job_id, artist, title, trim(coalesce(j->>'track', '')) AS track, {CLEAN} AS cleaned, trim(coalesce(j->>'channel', '')) AS channel
        FROM j),
    s AS (SELECT *, track = '' AND contains(cleaned, ' - ') AS cut FROM c),
    w AS (SELECT *, CASE WHEN cut THEN trim(split_part(cleaned, ' - ', 1)) ELSE '' END AS who,
                 CASE WHEN cut THEN trim(substr(cleaned, strpos(cleaned, ' - ') + 3)) WHEN track = '' THEN cleaned ELSE track END AS what FROM s),
    names AS (SELECT job_id, coalesce(nullif(CASE WHEN who = '' THEN trim(regexp_replace(channel, '\\s*-\\s*Topic\\s*$', ''))
        ELSE who END, ''), artist) AS artist,
                     coalesce(nullif(trim(split_part(what, '|', 1)), ''), title) AS title FROM w)"""

EVEN = """e AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, greatest(1.5e0, duration - 0.5e0) AS until FROM {turns}),
    ev AS (SELECT job_id, idx, text, duration, 0.5e0 + idx * ((until - 0.5e0) / n) AS start, least(until,
        greatest(0.5e0 + idx * ((until - 0.5e0) / n) + 0.2e0, 0.5e0 + (idx + 1) * ((until - 0.5e0) / n) - 0.05e0)) AS "end" FROM e)"""


def even(spark, d):
    turns = read(spark, d, "turns")
    return timeline.even_spacing(turns).withColumn("duration", F.lit(60.0))


AXIS = """md AS (SELECT job_id, ref_t, median(perf_t) AS m FROM {axis} GROUP BY job_id, ref_t),
    ax AS (SELECT job_id, ref_t, max(m) OVER (PARTITION BY job_id ORDER BY ref_t ROWS UNBOUNDED PRECEDING) AS perf_t FROM md)"""

#: b has rows (job_id, idx, n, text, duration); the times at equal shares of the job's active time.
SHARES = """c AS (SELECT *, sum(e - s) OVER (PARTITION BY job_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, sum(e - s) OVER (PARTITION BY job_id) AS total
        FROM iv),
    q AS (SELECT DISTINCT b.job_id, t.part, total * (t.part / cast(n AS double)) AS target FROM b JOIN c ON c.job_id = b.job_id, range(0, 100) t(part)
        WHERE t.part <= n),
    x AS (SELECT q.job_id, part, min(s + greatest(0e0, target - (upto - (e - s)))) FILTER (upto >= target - 1e-9) AS t FROM q
        JOIN c ON c.job_id = q.job_id GROUP BY q.job_id, part),
    y AS (SELECT b.*, l.t AS a, CASE WHEN b.idx + 1 < n THEN r.t - 0.04e0 ELSE r.t END AS b_ FROM b JOIN x l ON l.job_id = b.job_id AND l.part = b.idx
        JOIN x r ON r.job_id = b.job_id AND r.part = b.idx + 1),
    f AS (SELECT job_id, idx, a AS start, CASE WHEN least(duration, greatest(b_, a + 0.8e0)) <= a THEN least(duration, a + 0.2e0)
        ELSE least(duration, greatest(b_, a + 0.8e0)) END AS "end" FROM y WHERE idx = 0
          UNION ALL SELECT job_id, idx, start, CASE WHEN least(duration, greatest(b_, start + 0.8e0)) <= start THEN least(duration, start + 0.2e0)
              ELSE least(duration, greatest(b_, start + 0.8e0)) END
          FROM (SELECT y.*, CASE WHEN y.a < f."end" THEN f."end" + 0.03e0 ELSE y.a END AS start FROM f JOIN y ON y.job_id = f.job_id
              AND y.idx = f.idx + 1))"""
