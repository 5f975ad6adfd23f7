"""Job tables made from the test tables. The SELECTs are plain enough for Spark and the comparing engine alike; {name} is a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SELECTS = {
    "turns": """
        SELECT cast(conv_id AS string) AS job_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS int) AS idx, role,
               text, split_part(text, '.', 1) AS sync_text, 60e0 AS duration FROM {conversations}""",
    "lyrics": """
        SELECT job_id, 60e0 AS duration, string_agg(line, chr(10) ORDER BY idx) AS text FROM (
            SELECT job_id, idx, '[' || lpad(cast(cast(floor(t / 60) AS int) AS string), 2, '0') || ':' || lpad(cast(cast(floor(t) AS int) % 60 AS string), 2, '0') || '.' ||
                   CASE WHEN idx % 2 = 0 THEN '25' ELSE '5' END || '] ' || CASE WHEN idx % 4 = 3 THEN '' ELSE replace(sync_text, chr(10), ' ') END AS line
            FROM (SELECT *, 1e0 + idx * 3.25e0 AS t FROM ({turns}))) GROUP BY job_id""",
    "songs": """
        SELECT p.job_id, 60e0 AS duration, 0.5e0 AS "offset", 'Every non-empty line' AS grouping,
               CASE WHEN p.k IN (0, 4) THEN 'Even spacing' WHEN p.k IN (1, 2) THEN 'Manual anchors' WHEN p.k = 3 THEN 'Vocal activity sequential' WHEN p.k = 5 THEN 'no such mode' ELSE 'Whisper fuzzy match' END AS mode,
               CASE WHEN p.k = 1 THEN '# two' || chr(10) || '1 = 2' || chr(10) || '3: 0:20.5' WHEN p.k = 2 THEN '1 = 1.5:20' END AS anchors,
               CASE WHEN p.k = 4 THEN l.text WHEN p.k = 6 THEN '  ' ELSE p.text END AS text
        FROM (SELECT job_id, cast(job_id AS int) % 7 AS k, string_agg(line, chr(10) ORDER BY idx) AS text FROM (SELECT job_id, idx, replace(sync_text, chr(10), ' ') AS line FROM ({turns})) GROUP BY job_id) p
        JOIN ({lyrics}) l ON l.job_id = p.job_id""",
    "ballads": """
        SELECT job_id, idx, line, 1e0 + idx * 3.5e0 AS t, 200e0 AS duration FROM (
            SELECT cast(cast(floor(conv_id / 2e0) AS bigint) AS string) AS job_id, cast(row_number() OVER (PARTITION BY floor(conv_id / 2e0) ORDER BY conv_id, turn, text) - 1 AS int) AS idx, line
            FROM (SELECT *, trim(substr(replace(split_part(text, '.', 1), chr(10), ' '), 1, 60)) AS line FROM {conversations}) WHERE length(line) > 20)""",
    "frames": """
        SELECT cast(user_id AS string) AS job_id, cast(n AS int) AS frame, n * 0.1e0 AS t, abs(value) AS rms, cast(count(*) OVER (PARTITION BY user_id) AS double) * 0.1e0 AS duration
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events})""",
    "spells": """
        SELECT cast(user_id AS string) AS job_id, (event_id * 37 % 3600) / 10e0 AS start, (event_id * 37 % 3600) / 10e0 + 0.1e0 + (event_id % 7) / 2e0 AS "end", 361e0 AS duration FROM {events}""",
    "captions": """
        SELECT job_id, idx, idx * 6e0 + (o_custkey % 5) * 1.2e0 AS start, idx * 6e0 + (o_custkey % 5) * 1.2e0 + 3e0 AS "end", o_orderkey, 100e0 AS duration FROM (
            SELECT *, cast(floor(o_orderkey / 8e0) AS bigint) AS job_id, cast(row_number() OVER (PARTITION BY floor(o_orderkey / 8e0) ORDER BY o_orderkey) - 1 AS int) AS idx FROM {orders})""",
    "candidates": """
        SELECT job_id, idx, cast(k AS int) AS cand_idx, start + (l_partkey % 61 - 30) / 20e0 AS start, start + (l_partkey % 61 - 30) / 20e0 + (l_suppkey % 50) / 12e0 + 0.1e0 AS "end",
               (l_partkey % 37) / 100e0 AS confidence, (l_suppkey % 100) / 100e0 AS collapsed_ratio, cast(idx + 1 - k % 3 AS string) || '-' || cast(idx + 5 AS string) AS source
        FROM (SELECT c.job_id, c.idx, c.start, l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k
              FROM {lineitem} l JOIN ({captions}) c ON c.o_orderkey = l.l_orderkey)""",
    "axis": """
        SELECT cast(user_id AS string) AS job_id, (event_id % 50) * 2e0 AS ref_t, (event_id % 50) * 2.1e0 + (event_id * 7 % 13) / 10e0 AS perf_t FROM {events}""",
    "probes": """
        SELECT cast(user_id AS string) AS job_id, event_id, (event_id * 13 % 1100) / 10e0 AS x, 100e0 AS duration FROM {events}""",
    "raw_starts": """
        SELECT cast(user_id AS string) AS job_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS int) AS idx, (event_id * 29 % 977) / 10e0 AS raw, 98e0 AS duration FROM {events}""",
    "vectors": """
        SELECT cast(a.label AS string) AS job_id, a.vec_id, a.embedding AS va, b.embedding AS vb FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
    "payloads": """
        SELECT p_partkey AS job_id, 'fallback artist' AS artist, 'fallback title' AS title,
               chr(123) || '"title": "' || CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' - ' ELSE '' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (Official Video)' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' | live' ELSE '' END ||
               '", "channel": "' || CASE WHEN p_partkey % 2 = 0 THEN p_type || ' - Topic' ELSE '' END || '", "track": "' || CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_type || ' ' ELSE '' END || '", "artist": null' || chr(125) AS payload FROM {part}""",
    "records": """
        SELECT cast(p_size AS string) AS job_id, p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS id, p_name AS "trackName", p_brand AS "artistName",
               p_type AS "albumName", cast(p_partkey % 3 + 200 AS double) AS duration, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '[00:01.00] ' || p_name || chr(10) || '[00:05.00] ' || p_type END AS "syncedLyrics" FROM {part}""",
    "entries": """
        SELECT cast(o_custkey AS string) AS job_id, cast(o_orderkey AS int) AS pos, cast(o_orderkey AS string) AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'x - Topic' ELSE o_orderstatus END AS channel,
               cast(o_orderkey * 31 % 400 AS double) AS duration FROM {orders}""",
    "targets": """
        SELECT cast(c_custkey AS string) AS job_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE '' END AS artist, CASE WHEN c_custkey % 3 = 0 THEN 'Urgent' ELSE 'High' END AS title, cast(150 + c_custkey % 100 AS double) AS target FROM {customer}""",
    "catalog": """
        SELECT doc_id AS seq, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END AS id, head AS "trackName", split_part(coalesce(text, ''), ' ', 7) || ' ' || coalesce(source, '') AS "artistName", lang AS "albumName",
               cast(doc_id % 300 + 60 AS double) AS duration, CASE WHEN doc_id % 6 = 0 THEN '' ELSE '[00:01.00] ' || head || chr(10) || '[00:05.00] la' END AS "syncedLyrics" FROM ({heads})""",
    "heads": """
        SELECT *, replace(split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) || ' ' || split_part(t, ' ', 3) || ' ' || split_part(t, ' ', 4) || ' ' || split_part(t, ' ', 5), chr(10), ' ') AS head
        FROM (SELECT *, coalesce(text, '') AS t FROM {documents})""",
    "wanted": """
        SELECT cast(doc_id AS string) AS job_id, CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 4 = 0 THEN 'someone' ELSE split_part(t, ' ', 7) || ' ' || coalesce(source, '') END AS artist,
               CASE WHEN doc_id % 3 = 0 THEN split_part(head, ' ', 3) || ' ' || split_part(head, ' ', 2) || ' ' || split_part(head, ' ', 1) || ' | live' WHEN doc_id % 3 = 1 THEN upper(replace(head, 'ß', 'ss')) || ' (Official Audio)' ELSE '「' || head || '」 of old' END AS title,
               cast(doc_id % 300 + 62 AS double) AS duration, 2 AS lines FROM ({heads})""",
    "texts": """SELECT cast(doc_id AS string) AS job_id, coalesce(text, '') AS text, 3600e0 AS duration FROM {documents}""",
}


def select(name: str, table=lambda t: t) -> str:
    """The SELECT of an input in brackets, with the inputs it uses in place and table(t) for each test table."""
    return "(" + re.sub(r"\{(\w+)\}", lambda m: select(m[1], table)[1:-1] if m[1] in SELECTS else table(m[1]), SELECTS[name]).strip() + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or an input over Spark's reading of the test tables."""
    if name not in SELECTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = select(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`").replace("chr(10) ORDER BY idx)", "chr(10)) WITHIN GROUP (ORDER BY idx)")
    return spark.sql("SELECT * FROM " + re.sub(r'"(end|offset|trackName|artistName|albumName|syncedLyrics)"', r"`\1`", text))
