"""Time maps of two recordings: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import timemap
from strandline.plans.base import query, rounded
from strandline.plans.fragments import AXIS
from strandline.plans.inputs import read


@query(f"WITH {AXIS} SELECT job_id, ref_t, round(perf_t, 6) AS perf_t FROM ax")
def time_axis_median(spark, d):
    return rounded(timemap.time_axis(read(spark, d, "axis")), "perf_t")


@query(f"""WITH {AXIS}, st AS (SELECT job_id, quantile_cont(perf_t - ref_t, 0.05) AS lo, quantile_cont(perf_t - ref_t, 0.5) AS mid,
        quantile_cont(perf_t - ref_t, 0.95) AS hi FROM ax GROUP BY job_id)
    SELECT job_id, round(mid, 6) AS "offset", round(hi - lo, 6) AS spread, CASE WHEN hi - lo <= 6 THEN 'multiscale'
        WHEN (hi - lo) / 2 <= 6 THEN 'legacy' ELSE 'invalid' END AS method FROM st""")
def time_map_stats(spark, d):
    s = timemap.axis_stats(timemap.time_axis(read(spark, d, "axis")))
    return rounded(s.withColumn("method", timemap.choose_method(F.lit(0.2), F.lit(0.2), F.col("spread"), F.col("spread") / 2, F.lit(6.0))), "offset", "spread")


@query(f"""WITH {AXIS}, b AS (SELECT job_id, min(ref_t) AS lo, max(ref_t) AS hi FROM ax GROUP BY job_id HAVING max(ref_t) > min(ref_t)),
    two AS (SELECT job_id, ref_t, perf_t AS y1, perf_t + 0.25e0 + ref_t / 100e0 AS y2 FROM ax),
    g AS (SELECT job_id, k, lo + (hi - lo) * k / 499e0 AS x FROM b, range(0, 500) t(k)),
    q AS (SELECT g.*, max(a.ref_t) FILTER (a.ref_t <= x) AS x0, min(a.ref_t) FILTER (a.ref_t >= x) AS x1 FROM g JOIN two a ON a.job_id = g.job_id
        GROUP BY g.job_id, k, x),
    y AS (SELECT q.job_id, abs((p.y2 - p.y1) + CASE WHEN x1 > x0 THEN ((n.y2 - n.y1) - (p.y2 - p.y1)) / (x1 - x0) * (x - x0) ELSE 0 END) AS d
          FROM q JOIN two p ON p.job_id = q.job_id AND p.ref_t = coalesce(x0, x1) JOIN two n ON n.job_id = q.job_id AND n.ref_t = coalesce(x1, x0))
    SELECT job_id, round(quantile_cont(d, 0.95), 6) AS p95 FROM y GROUP BY job_id""")
def time_map_disagreement(spark, d):
    one = timemap.time_axis(read(spark, d, "axis"))
    return rounded(timemap.disagreement(one, one.withColumn("perf_t", F.col("perf_t") + 0.25 + F.col("ref_t") / 100)), "p95")


@query("""WITH v AS (SELECT job_id, list_sum(list_transform(va, lambda x: cast(x AS double) * x)) AS na, list_sum(list_transform(vb,
        lambda x: cast(x AS double) * x)) AS nb, 1 - list_sum(list_transform(list_zip(va, vb),
        lambda z: cast(z[1] AS double) * cast(z[2] AS double))) AS dist FROM {vectors}),
    g AS (SELECT job_id, avg(dist) FILTER (na > 1e-6 AND nb > 1e-6) AS c, count(*) FILTER (na > 1e-6 AND nb > 1e-6) AS n FROM v GROUP BY job_id)
    SELECT job_id, round(CASE WHEN n >= 20 THEN c ELSE 1e0 END, 6) AS cost FROM g""")
def feature_cost(spark, d):
    v = read(spark, d, "vectors").select("job_id", F.col("va").cast("array<double>").alias("a"), F.col("vb").cast("array<double>").alias("b"))
    return rounded(
        timemap.feature_cost(v.select(
            "job_id", F.col("a").alias("chroma_a"), F.col("b").alias("chroma_b"), F.col("a").alias("onset_a"), F.col("b").alias("onset_b")
        )),
        "cost"
    )


def _pitch_classes():
    """All numbers of an embedding as twelve: what lies twelve places apart is one."""
    own = lambda i: F.filter("embedding", lambda x, k: k % 12 == i)
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.abs(F.aggregate(own(i), F.lit(0.0), lambda t, x: t + x.cast("double"))))


_DECAY = " + ".join(["e", *(f"coalesce(lag(e, {k}) OVER w, 0e0) / sqrt({k + 1}e0)" for k in range(1, 10))])


@query(f"""WITH a AS (SELECT cast(label AS varchar) AS job_id, vec_id AS frame, b AS bin, abs(list_sum(list_transform(list_filter(embedding, lambda y, k: (k - 1) % 12 = b - 1), lambda y: cast(y AS double)))) AS x
        FROM embeddings, range(1, 13) t(b)),
    d AS (SELECT *, greatest(0e0, x - coalesce(lag(x) OVER w, x)) AS d FROM a WINDOW w AS (PARTITION BY job_id, bin ORDER BY frame)),
    e AS (SELECT *, ln(1e0 + 100 * d) / (ln(1e0 + 100 * max(d) OVER (PARTITION BY job_id, bin ORDER BY frame ROWS BETWEEN 20 PRECEDING
        AND 19 FOLLOWING)) + 1e-8) AS e FROM d),
    f AS (SELECT job_id, frame, bin, {_DECAY} AS v FROM e WINDOW w AS (PARTITION BY job_id, bin ORDER BY frame)),
    g AS (SELECT *, greatest(1e-8, sqrt(sum(v * v) OVER (PARTITION BY job_id, frame))) AS norm FROM f)
    SELECT job_id, frame, list(round(v / norm, 6) ORDER BY bin) AS onset FROM g GROUP BY job_id, frame""")
def onset_features(spark, d):
    v = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("job_id"), F.col("vec_id").alias("frame"), _pitch_classes().alias("chroma"))
    out = timemap.onsets(v)
    return out.select("job_id", "frame", F.transform("onset", lambda x: F.round(x, 6)).alias("onset"))


def _recordings(spark, d):
    """Two recordings a label: its vectors with even and with odd ids, as unit chroma and onsets, repeated to two seconds and more."""
    v = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("job_id"), "vec_id", _pitch_classes().alias("c"))
    unit = F.transform("c", lambda x: x / F.greatest(F.lit(1e-8), F.sqrt(F.aggregate("c", F.lit(0.0), lambda t, y: t + y * y))))
    side = F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("perf")
    rows = v.select(
        "job_id", side.alias("side"), F.expr("row_number() OVER (PARTITION BY job_id, vec_id % 2 ORDER BY vec_id) - 1").alias("frame"),
        unit.alias("chroma")
    )
    return rows.withColumn("onset", F.col("chroma"))


@query()
def warping_paths(spark, d):
    return timemap.time_axis(timemap.build_paths(_recordings(spark, d), 10.0))


@query()
def multiscale_paths(spark, d):
    return timemap.time_axis(timemap.build_paths(_recordings(spark, d), 10.0, "multiscale"))


@query()
def time_map_choice(spark, d):
    """The chosen map's axis with the report's verdict on each job, those without a map among them."""
    from strandline.operators.reference import best_map

    axis, report = best_map(_recordings(spark, d), 10.0)
    rows = report.join(axis, "job_id", "left").select(
        "job_id", "method", "error", "shift", "multiscale_cost", "legacy_cost", "multiscale_spread", "legacy_spread", "disagreement",
        "ref_t", "perf_t"
    )
    return rounded(rows, "multiscale_cost", "legacy_cost", "multiscale_spread", "legacy_spread", "disagreement")
