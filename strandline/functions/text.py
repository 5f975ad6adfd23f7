"""Text keys, similarity, metadata clean-up, time and colour literals, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.arrays import bound, field
from strandline.functions.similar import ratios, ratios_from

# The matching alphabet (digits, a-z, kana, CJK, Hangul), words that end a track title, what is taken for a bracket or a Latin
# run in one, the bar before a suffix.
ALPHABET = "0-9a-z぀-ヿ㐀-鿿가-힣"
NOISE_WORDS = r"official|audio|video|lyrics?|mv"
IN_BRACKETS = r"[(\[{【「『]([^)\]}】」』]+)[)\]}】」』]"
LATIN_RUN = r"[A-Za-z0-9][A-Za-z0-9 '&.,!?\-]+"
BAR = r"(?U)\s*[|｜]\s*"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def spaced_key(c: Column) -> Column:
    """Lower case; everything outside the alphabet is one space."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^{ALPHABET}]+", " "))


def match_key(c: Column) -> Column:
    """Lower case; everything outside the alphabet is dropped."""
    return F.replace(spaced_key(c), F.lit(" "), F.lit(""))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts by their match keys. The keys are made by Spark, only the ratio is Python."""
    return _ratio(match_key(a), match_key(b))


def track_key(c: Column) -> Column:
    """Key of a track or artist name: case folded, without bracketed parts and without what follows a noise word."""
    c = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    c = F.regexp_replace(c, r"(?s)[(\[{].*?[)\]}]", " ")
    c = F.regexp_replace(c, rf"(?U)\b(?:feat(?:uring)?|ft|{NOISE_WORDS})\b.*", " ")
    return F.regexp_replace(c, f"[^{ALPHABET}]+", "")


def metadata_similarity(a: Column, b: Column) -> Column:
    """0 if a key is empty; if one holds the other, the ratio of their lengths; else their similarity."""
    x, y = track_key(a), track_key(b)
    low, high = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(F.contains(x, y) | F.contains(y, x), low / high).otherwise(_ratio(x, y))


@F.pandas_udf(T.DoubleType())
def _key_similarity(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out = [0.0 if not x or not y else min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else None for x, y in zip(a, b, strict=True)]
    known = pd.Series(out, dtype="float64")
    rest = known.isna().to_numpy()
    known[rest] = ratios_from(a[rest].tolist(), b[rest].tolist(), least[rest].to_numpy())
    return known.where(known >= least)


#: The metadata similarity of names with two track keys; null where it is under a third number. A filter on it must not make it anew.
key_similarity = _key_similarity.asNondeterministic()


def title_variants(title: Column) -> Column:
    """Search titles: the title, what stands before a bar, bracket contents, Latin runs; each cut at a noise word, of two characters or
    more, without repeats (case folded), in order."""

    def parts(plain: Column) -> Column:
        inside = F.regexp_extract_all(plain, F.lit(IN_BRACKETS), F.lit(1))
        latin = F.regexp_extract_all(plain, F.lit(LATIN_RUN), F.lit(0))
        return F.concat(F.array(strip(title), plain), F.transform(inside, strip), F.transform(latin, strip))

    found = F.transform(
        bound(strip(F.get(F.split(title, BAR, 2), F.lit(0))), parts),
        lambda v: F.regexp_replace(F.regexp_replace(v, rf"(?iU)\b(?:{NOISE_WORDS}|translation)\b.*", ""), r"^[ \-_.,!]+|[ \-_.,!]+$", "")
    )
    found = F.transform(F.filter(found, lambda v: F.length(v) >= 2), lambda v: F.struct(v.alias("v"), F.lower(v).alias("low")))
    # the array is made once, not for each of its elements anew
    first = bound(found, lambda all_: F.filter(all_, lambda v, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda w: w["low"] == v["low"])))
    return field(first, "v")


def sync_line(text: Column, choice: Column | str) -> Column:
    """The line of a block that is matched: "Line 1" to "Line 3" (the last one where there are fewer), "Last line", or else all joined by spaces."""
    choice = F.lit(choice) if isinstance(choice, str) else choice
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    number = F.regexp_extract(choice, r"^Line ([1-3])$", 1).try_cast("int")
    return F.coalesce(
        F.when(F.size(lines) == 0, F.lit("")).when(
            number.isNotNull(), F.get(lines, F.least(number, F.size(lines)) - 1)
        ).when(choice == "Last line", F.get(lines, F.size(lines) - 1)).otherwise(F.array_join(lines, " ")),
        F.lit(""),
    )


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, rounded half to even."""
    n = F.rint(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.concat(
        (n / 360000).cast("long").cast("string"), F.lit(":"), _pad(F.floor(n / 6000) % 60, 2), F.lit(":"), _pad(F.floor(n / 100) % 60, 2),
        F.lit("."), _pad(n % 100, 2)
    )


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded half to even."""
    n = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    hours = F.floor(n / 3600000)
    return F.concat(
        F.when(hours > 99, hours.cast("string")).otherwise(_pad(hours, 2)), F.lit(":"), _pad(F.floor(n / 60000) % 60, 2), F.lit(":"),
        _pad(F.floor(n / 1000) % 60, 2), F.lit(","), _pad(n % 1000, 3)
    )


def ass_color(rgb: Column, alpha: str = "00") -> Column:
    """&HaaBBGGRR of #RRGGBB; white where there aren't six digits."""
    v = F.regexp_replace(strip(rgb), "^#+", "")
    v = F.when(F.length(v) == 6, v).otherwise("FFFFFF")
    return F.upper(F.concat(F.lit(f"&H{alpha}"), F.substring(v, 5, 2), F.substring(v, 3, 2), F.substring(v, 1, 2)))


def ass_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_counts(text: Column) -> list[Column]:
    """Hangul, kana and Latin letters in a text."""
    return [F.regexp_count(text, F.lit(p)) for p in ("[가-힣]", "[぀-ヿ]", "[A-Za-z]")]


def language_of(hangul: Column, kana: Column, latin: Column, configured: Column | None = None) -> Column:
    """ko, ja, en or null from summed counts; a configured language other than "auto" stands."""
    found = F.when(hangul >= F.greatest(F.lit(1), kana, latin), "ko").when(kana >= F.greatest(F.lit(1), hangul), "ja").when(latin > 0, "en")
    return found if configured is None else F.when(configured != "auto", configured).otherwise(found)


def source_low(source: Column) -> Column:
    """lo of a window "lo-hi", else null."""
    return F.when(source.rlike(r"^[0-9]+-[0-9]+$"), F.split(source, "-")[0].cast("int"))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, r"[^0-9a-zA-Z가-힣_\-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "subtitle").otherwise(s)


def job_id(path: Column, artist: Column, title: Column) -> Column:
    """Twelve hex digits of a job's inputs; without the clock, so that a job that is run again keeps its id."""
    return F.substring(F.sha1(F.concat_ws("|", path, artist, title)), 1, 12)
