"""The registered queries of the training-data operators, each a thin use of its operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, jaccard, jpeg, kneserney, language, licences, linefreq, merkle, packing, pieces, resampling, secrets, warc
from .common import fold
from .oracles import ORACLE as _LONG


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """What a job over whole texts should set, and these queries, which are such jobs, do: 1,000 rows a batch for Python in place of Spark's
    default of 10,000, as a batch is held in full on both sides. A session with another number keeps it. No operator calls this or changes a
    session."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, in a session that is prepared for it."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark, sf_dir):
    captures = warc.archive_pages(table(spark, sf_dir, "pages"), payloads=False)
    refers = F.get(F.filter("answer.fields", lambda f: f["name"] == "x-refers-to-page"), F.lit(0))["value"].cast("long")
    return captures.select(
        F.col("answer.page_id").alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"), F.col("answer.payload_digest").alias("payload_digest"),
        F.col("answer.record_type").alias("record_type"), refers.alias("refers_to"),
    )


def op2_sum_of_squares_packing(spark, sf_dir):
    rows = packing.pack_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_sentencepiece_prefix_table(spark, sf_dir):
    rows = pieces.encode_decode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_brown_class_model(spark, sf_dir):
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op5_line_frequency(spark, sf_dir):
    return linefreq.line_quality(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language.predict_language(docs, language.fit_language(docs))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_classifier(spark, sf_dir):
    return kneserney.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_id")


def op8_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_secret_scan(spark, sf_dir):
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(
            F.array_join(F.transform(base, text), ",").cast("binary"), 256
        ).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def op10_baseline_jpeg(spark, sf_dir):
    rows = jpeg.read_media(jpeg.text_media(table(spark, sf_dir, "documents")))
    size = F.octet_length("thumbnail").cast("long")
    return rows.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"), F.crc32(F.substring("thumbnail", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.format_string(
            "%dx%d:%s", "width", "height", "thumbnail_hash"
        ).alias("feature"),
    )


def op11_merkle_manifest(spark, sf_dir):
    rows = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_importance_resampling(spark, sf_dir):
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_license_scan(spark, sf_dir):
    rows = licences.license_labels(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


QUERIES = {f.__name__: f for f in (
    op1_warc_transactions, op2_sum_of_squares_packing, op3_sentencepiece_prefix_table, op4_brown_class_model, op5_line_frequency,
    op6_language_id, op7_quality_classifier, op8_jaccard_join, op9_secret_scan, op10_baseline_jpeg, op11_merkle_manifest,
    op12_importance_resampling, op13_license_scan
)}

ORACLE = {
    **_LONG,
    "op1_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
             l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to
        FROM l""",
    "op5_line_frequency": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t FROM documents),
             w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
             win AS (SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
             twice AS (SELECT r, win FROM win GROUP BY r, win HAVING count(*) > 1),
             rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(range(win.i, win.i + 8)) AS p FROM win JOIN twice ON twice.r = win.r AND twice.win = win.win) GROUP BY r),
             raw AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
             full_ AS (SELECT r, host, ('0x' || substr(md5(t), 1, 15))::BIGINT AS digest, l, list_filter(regexp_split_to_array(lower(l), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
                       FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
             dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM full_ GROUP BY r),
             common AS (SELECT host, lw, min(digest) AS first FROM full_ GROUP BY host, lw HAVING count(DISTINCT digest) > 10),
             lost AS (SELECT f.r, sum(len(f.lw)) AS n FROM full_ f JOIN common c ON c.host = f.host AND c.lw = f.lw WHERE f.digest <> c.first GROUP BY f.r),
             f AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
                          (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                          coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
                   FROM d JOIN w ON w.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN rep ON rep.r = d.r LEFT JOIN lost ON lost.r = d.r)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
        FROM f""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
             links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
             reach AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.x)
        SELECT reach.x AS doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(reach.c) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.x GROUP BY reach.x""",
}
