"""Time maps between two recordings: features, warping paths, axes, quality, choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.timeline import interpolate
from strandline.sources.scans import signal

BINS = 12


def time_axis(path: DataFrame) -> DataFrame:
    """job_id, ref_t, perf_t: the median performance time of each reference time, never falling."""
    rows = path.groupBy("job_id", "ref_t").agg(F.median("perf_t").alias("m"))
    return rows.select(
        "job_id", "ref_t",
        F.max("m").over(Window.partitionBy("job_id").orderBy("ref_t").rowsBetween(Window.unboundedPreceding, 0)).alias("perf_t")
    )


def axis_stats(axis: DataFrame) -> DataFrame:
    """job_id, offset (median), spread (95th less 5th percentile) of performance less reference time."""
    p = F.percentile(F.col("perf_t") - F.col("ref_t"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return axis.groupBy("job_id").agg(p.alias("p")).select("job_id", F.col("p")[1].alias("offset"), (F.col("p")[2] - F.col("p")[0]).alias("spread"))


def disagreement(one: DataFrame, other: DataFrame, probes: int = 500) -> DataFrame:
    """job_id, p95 of the absolute difference of two axes at evenly spaced reference times of the part both cover."""
    low = lambda a: a.groupBy("job_id").agg(F.min("ref_t").alias("lo"), F.max("ref_t").alias("hi"))
    b = low(one).join(low(other).withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), "job_id").select(
        "job_id", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")
    ).where("hi > lo")
    grid = b.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("k"), "lo", "hi").select(
        "job_id", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (probes - 1)).alias("x"), F.lit(1e18).alias("duration")
    )
    both = interpolate(grid, one).withColumnRenamed("y", "y1")
    both = interpolate(both, other).withColumnRenamed("y", "y2")
    return both.groupBy("job_id").agg(F.percentile(F.abs(F.col("y1") - F.col("y2")), F.lit(0.95)).alias("p95"))


def choose_method(mq: Column, lq: Column, ms: Column, ls: Column, most: Column) -> Column:
    """multiscale, legacy or invalid, by costs (lower is better) and spreads of two maps."""
    m, l = F.coalesce(ms <= most, F.lit(False)), F.coalesce(ls <= most, F.lit(False))  # noqa: E741
    return F.when(m & l, F.when(mq <= lq + 0.025, "multiscale").otherwise("legacy")).when(m, "multiscale").when(l, "legacy").otherwise("invalid")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the dot product of two unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def feature_cost(pairs: DataFrame) -> DataFrame:
    """job_id, cost of aligned frames (job_id, chroma_a, chroma_b, onset_a, onset_b): 0.75 of the chroma's mean distance and 0.25 of the
    onsets', over frames with energy on both sides; 1 where fewer than 20 are."""
    energy = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)

    def part(name: str) -> list[Column]:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        on = (energy(a) > 1e-6) & (energy(b) > 1e-6)
        return [F.avg(F.when(on, cosine_distance(a, b))).alias(f"{name}_cost"), F.count(F.when(on, 1)).alias(f"{name}_n")]

    g = pairs.groupBy("job_id").agg(*part("chroma"), *part("onset"))
    cost = lambda name: F.when(F.col(f"{name}_n") >= 20, F.col(f"{name}_cost")).otherwise(1.0)
    return g.select("job_id", (0.75 * cost("chroma") + 0.25 * cost("onset")).alias("cost"))


def onsets(frames: DataFrame) -> DataFrame:
    """job_id, frame, onset (12 numbers) of chroma frames: rises between frames, by the log of their share of a local maximum over 40
    frames, decayed over 10 frames, to unit length."""
    w = Window.partitionBy("job_id", "bin").orderBy("frame")
    x = frames.select("job_id", "frame", F.posexplode("chroma").alias("bin", "x"))
    x = x.withColumn("x", F.greatest(F.lit(0.0), F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))))
    x = x.withColumn("x", F.log1p(100 * F.col("x")) / (F.log1p(100 * F.max("x").over(w.rowsBetween(-20, 19))) + 1e-8))
    x = x.withColumn("x", sum((F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) * float(1 / np.sqrt(k + 1)) for k in range(1, 10)), F.col("x")))
    g = x.groupBy("job_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.greatest(F.lit(1e-8), F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, y: t + y * y)))
    return g.select("job_id", "frame", F.transform("v", lambda y: y / norm).alias("onset"))


def quantised(chroma: Column) -> Column:
    """Each pitch class's share of the frame's energy in quarters: one for each of 5, 10, 20 and 40 % that it exceeds."""
    total = F.aggregate(chroma, F.lit(0.0), lambda t, x: t + F.abs(x))
    step = lambda x: sum((F.when(x > s, 0.25).otherwise(0.0) for s in (0.05, 0.1, 0.2)), F.when(x > 0.4, 0.25).otherwise(0.0))
    return F.transform(chroma, lambda x: F.when(total > 1e-3, step(x / total)).otherwise(0.0))


def chroma(samples: np.ndarray, rate: int, hop: int, size: int = 4096) -> np.ndarray:
    """Unit energy of the 12 pitch classes in each frame of a signal, a frame every `hop` samples."""
    x = np.pad(np.asarray(samples, dtype=np.float64), size // 2)
    starts = np.arange(0, max(1, len(x) - size + 1), hop)
    window = np.hanning(size)
    freq = np.fft.rfftfreq(size, 1 / rate)
    use = (freq > 27.5) & (freq < 5000)
    pitch = np.zeros((len(freq), BINS))
    pitch[np.flatnonzero(use), np.round(12 * np.log2(freq[use] / 440.0) + 9).astype(int) % BINS] = 1.0
    frames = np.lib.stride_tricks.sliding_window_view(x, size)
    parts = [np.abs(np.fft.rfft(frames[starts[k : k + 256]] * window, axis=1)) ** 2 @ pitch for k in range(0, len(starts), 256)]
    out = np.concatenate(parts)
    return out / np.maximum(1e-8, np.linalg.norm(out, axis=1, keepdims=True))


def music_features(files: DataFrame, rate: int = 22_050, frames_a_second: int = 50) -> DataFrame:
    """job_id (the path), frame, chroma (quantised), onset of 16-bit WAV files read by Spark's binaryFile source. A file is decoded by one
    task, a batch of frames at a time; all else are expressions and windows. Files that can't be read give no rows; scans.unreadable lists
    them."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x, _ = signal(content, rate)
                if len(x):
                    found = chroma(x, rate, rate // frames_a_second)
                    for k in range(0, len(found), 1 << 14):
                        part = found[k : k + (1 << 14)]
                        yield pd.DataFrame({"job_id": path, "frame": np.arange(k, k + len(part)), "chroma": list(part)})

    rows = files.select("path", "content").mapInPandas(run, "job_id string, frame int, chroma array<double>")
    return rows.select("job_id", "frame", quantised(F.col("chroma")).alias("chroma")).join(onsets(rows), ["job_id", "frame"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-8, np.linalg.norm(x, axis=1, keepdims=True))


def smooth(x: np.ndarray, window: int, step: int) -> np.ndarray:
    """Every step-th frame of x after a Hann window over `window` frames, to unit length."""
    w = np.hanning(window + 2)[1:-1]
    padded = np.pad(x, ((window // 2, window - 1 - window // 2), (0, 0)))
    at = np.arange(0, len(x), step)
    out = np.zeros((len(at), x.shape[1]))
    for k in range(window):
        out += w[k] * padded[at + k]
    return unit(out)


def banded_path(a: np.ndarray, b: np.ndarray, band: float | None = None, extra: float = 0.08) -> np.ndarray:
    """Pairs of frames of the cheapest path by cosine distance with steps (1,1), (1,2), (2,1), the latter two at an extra cost. No rows
    where the band has no path.

    The band keeps pairs whose places differ by less than a share of the shorter side, on the longer side's part by the difference of
    lengths more. Rows of the table are vectors over the band, so memory is one byte a cell of it."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.zeros((0, 2), dtype=int)
    band = min(0.20, max(0.08, abs(n - m) / max(n, m) + 0.04)) if band is None else band
    radius = max(1, round(band * min(n, m)))
    low, high = -(radius - 1) - max(0, n - m), radius - 1 + max(0, m - n)  # of j - i
    width = high - low + 1
    padded = np.zeros((n + width + m, a.shape[1]))
    padded[-low : m - low] = b  # row i's part begins at i
    inside = np.zeros(len(padded), dtype=bool)
    inside[-low : m - low] = True
    took = np.zeros((n, width), dtype=np.int8)
    none = np.full(width + 2, np.inf)  # sums by j - i - low, framed by infinities
    before, last = none, none
    for i in range(n):
        cost = np.where(inside[i : i + width], 1 - padded[i : i + width] @ a[i], np.inf)
        ways = np.stack([last[1:-1], last[:-2] + extra, before[2:] + extra])
        took[i] = ways.argmin(axis=0)
        now = none.copy()
        now[1:-1] = cost + ways.min(axis=0)
        if i == 0:
            now[1 - low] = cost[-low]
        before, last = last, now
    if not np.isfinite(last[1 + m - n - low]):
        return np.zeros((0, 2), dtype=int)
    path, i, j = [(n - 1, m - 1)], n - 1, m - 1
    while i or j:
        step = took[i, j - i - low]
        i, j = i - (2 if step == 2 else 1), j - (2 if step == 1 else 1)
        path.append((i, j))
    return np.array(path[::-1])


def _narrow(pairs_cost, n: int, m: int, centre: np.ndarray, radius: int, weights: tuple[float, float, float]) -> tuple[float, np.ndarray]:
    """(sum, pairs) of the cheapest path with steps (1,0), (0,1), (1,1), whose costs have weights, within `radius` of centre[i + j], a row
    for each sum of places.

    Anti-diagonals are vectors of 2 radius + 1 cells; pairs_cost gives the costs of arrays of places."""
    width = 2 * radius + 1
    low = np.clip(np.round(centre).astype(int) - radius, -radius, n - 1)
    offsets = np.arange(width)
    took = np.full((n + m - 1, width), 3, dtype=np.int8)
    before = last = np.full(width + 2, np.inf)

    def of(sums: np.ndarray, places: np.ndarray) -> np.ndarray:
        return sums[np.clip(places + 1, 0, width + 1)]

    for s in range(n + m - 1):
        i = low[s] + offsets
        j = s - i
        ok = (i >= 0) & (i < n) & (j >= 0) & (j < m)
        cost = np.full(width, np.inf)
        cost[ok] = pairs_cost(i[ok], j[ok])
        now = np.full(width + 2, np.inf)
        if s == 0:
            now[1:-1] = np.where(i == 0, cost, np.inf)
        else:
            ways = np.stack([
                of(last, i - 1 - low[s - 1]) + weights[0] * cost, of(last, i - low[s - 1]) + weights[1] * cost,
                (of(before, i - 1 - low[s - 2]) if s > 1 else np.full(width, np.inf)) + weights[2] * cost
            ])
            took[s] = ways.argmin(axis=0)
            now[1:-1] = ways.min(axis=0)
        before, last = last, now
    end = n - 1 - low[-1]
    if not 0 <= end < width or not np.isfinite(last[end + 1]):
        return np.inf, np.zeros((0, 2), dtype=int)
    path, i, j = [(n - 1, m - 1)], n - 1, m - 1
    while i or j:
        step = took[i + j, i - low[i + j]]
        i, j = i - (step != 1), j - (step != 0)
        path.append((i, j))
    return float(last[end + 1]), np.array(path[::-1])


#: Of steps in the one recording, in the other and in both; and the share of chroma in the finest costs.
WEIGHTS, CHROMA_SHARE = (1.5, 1.5, 2.0), 0.65


def multiscale_path(
    a: np.ndarray, b: np.ndarray, onset_a: np.ndarray | None = None, onset_b: np.ndarray | None = None, factor: int = 4, radius: int = 16
) -> np.ndarray:
    """A path on averaged frames first, then on finer ones near it, down to whole frames, whose costs are of chroma and onsets: time and
    memory follow the length, not the product of lengths."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), dtype=int)
    n, m = len(a), len(b)
    if min(n, m) < 4 * factor:
        centre, radius = np.arange(n + m - 1) / 2, n + m
    else:
        shrunk = lambda x: unit(np.stack([x[k : k + factor].mean(axis=0) for k in range(0, len(x), factor)]))
        rough = multiscale_path(shrunk(a), shrunk(b), factor=factor, radius=radius) * factor + (factor - 1) / 2
        centre = np.interp(np.arange(n + m - 1), rough.sum(axis=1), rough[:, 0])

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        chroma_cost = 1 - (a[i] * b[j]).sum(axis=1)
        if onset_a is None or onset_b is None:
            return chroma_cost
        return CHROMA_SHARE * chroma_cost + (1 - CHROMA_SHARE) * np.linalg.norm(onset_a[i] - onset_b[j], axis=1)

    return _narrow(cost, n, m, centre, radius, WEIGHTS)[1]


def rising(path: np.ndarray) -> np.ndarray:
    """The pairs of a path of which both places are beyond those of the last pair kept."""
    kept = []
    for p in path.tolist():
        if not kept or (p[0] > kept[-1][0] and p[1] > kept[-1][1]):
            kept.append(p)
    return np.array(kept, dtype=int).reshape(-1, 2)


def best_shift(a: np.ndarray, b: np.ndarray, window: int = 201, step: int = 50) -> int:
    """The number of semitones by which b must be turned for the cheapest path to a, on smoothed frames; the least among equals."""
    x, y = smooth(a, window, step), smooth(b, window, step)
    n, m = len(x), len(y)
    centre = np.arange(n + m - 1) * (n - 1) / max(1, n + m - 2)
    reach = max(8, abs(n - m), min(n, m) // 5)
    sums = [_narrow(lambda i, j, t=np.roll(y, k, axis=1): 1 - (x[i] * t[j]).sum(axis=1), n, m, centre, reach, (1.0, 1.0, 1.0))[0] for k in range(BINS)]
    return int(np.argmin(np.round(sums, 9)))


def wide(features: DataFrame) -> DataFrame:
    """job_id and, of each recording, chroma and onset as one array of BINS numbers a frame, frame after frame: one row a job that has both recordings."""
    rows = features if "onset" in features.columns else features.withColumn("onset", F.lit(None).cast("array<double>"))
    one = rows.groupBy("job_id", "side").agg(F.sort_array(F.collect_list(F.struct("frame", "chroma", "onset"))).alias("f"))
    flat = lambda name: F.flatten(F.transform("f", lambda x: x[name]))
    one = one.select("job_id", "side", flat("chroma").alias("chroma"), flat("onset").alias("onset"))
    side = lambda s: one.where(F.col("side") == s).select("job_id", F.col("chroma").alias(f"{s}_chroma"), F.col("onset").alias(f"{s}_onset"))
    return side("ref").join(side("perf"), "job_id")


def _frames(flat) -> np.ndarray | None:
    return None if flat is None else np.asarray(flat, dtype=np.float64).reshape(-1, BINS)


@F.pandas_udf(T.IntegerType())
def _shift(ref: pd.Series, perf: pd.Series) -> pd.Series:
    return pd.Series([best_shift(_frames(a), _frames(b)) for a, b in zip(ref, perf, strict=True)], dtype="int32")


def pitch_shifts(features: DataFrame) -> DataFrame:
    """job_id, shift (semitones, 0 to 11) by which the performance's pitch classes are turned to the reference's."""
    return wide(features).select("job_id", _shift("ref_chroma", "perf_chroma").alias("shift"))


def _path_finder(method: str, step: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(ref_chroma: pd.Series, ref_onset: pd.Series, perf_chroma: pd.Series, perf_onset: pd.Series) -> pd.Series:
        out = []
        for row in zip(ref_chroma, ref_onset, perf_chroma, perf_onset, strict=True):
            a, x, b, y = (_frames(f) for f in row)
            if method == "multiscale":
                path = rising(multiscale_path(unit(a), unit(b), x, y))
            else:
                path = banded_path(smooth(a, 41, step), smooth(b, 41, step)) * step
            out.append(path.ravel().tolist())
        return pd.Series(out, dtype=object)

    return run


def build_paths(features: DataFrame, rate: float, method: str = "legacy", frames_a_second: float = 10.0) -> DataFrame:
    """job_id, ref_t, perf_t of the path between a job's two recordings (job_id, side "ref" or "perf", frame, chroma and, for the multiscale
    one, onset); a job without a path gives no rows.

    A path is sequential: it is found by one Arrow function over a job's packed frames. The legacy one works on smoothed frames, about
    frames_a_second of them."""
    find = _path_finder(method, max(1, round(rate / frames_a_second)))
    found = wide(features).select("job_id", find("ref_chroma", "ref_onset", "perf_chroma", "perf_onset").alias("p"))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("p") / 2).cast("int") - 1),
        lambda k: F.struct((F.get("p", 2 * k) / rate).alias("ref_t"), (F.get("p", 2 * k + 1) / rate).alias("perf_t"))
    )
    return found.where(F.size("p") > 0).select("job_id", F.explode(pairs).alias("t")).select("job_id", "t.*")
