"""DuckDB SQL of the queries whose results plain SQL can express at length: Merkle manifest, importance resampling, license scan."""

from __future__ import annotations

from .licences import NOTICES, PHRASES, notices

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: tab has one row with the 256 entries of the table by bytes.
_CRC_TABLE = """
    bits(n, k, c) AS (SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
                      UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY n) AS entries FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """crc32 of a text, beside tab."""
    byte = "('0x' || substr(hex(encode({t})), (2 * i + 1)::BIGINT, 2))::BIGINT"
    listed = f"list_transform(range(strlen({text})), lambda i: {byte.format(t=text)})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda a, b: xor(entries[(xor(a, b) & 255) + 1], a >> 8)))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _merkle() -> str:
    leaf = lambda text: "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    beside = "string_agg(h, '') OVER (PARTITION BY key, lvl, pos // 16 ORDER BY pos ROWS BETWEEN {})"
    sides = f"""coalesce({beside.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS l, coalesce({beside.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS r"""
    climb = """UNION ALL SELECT key, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
                                       FROM {t} WHERE n > 1 GROUP BY key, lvl, pos // 16, n"""
    return f"""
        WITH RECURSIVE {_CRC_TABLE.strip()},
        d AS (SELECT doc_id, coalesce('k' || source, '') AS key, {leaf("text")} AS leaf, {leaf(_LOWER.format("text"))} AS low,
                     {_crc("doc_id::VARCHAR")} % 5 = 0 AS chosen FROM documents, tab),
        p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d),
        tree(key, lvl, pos, h, n) AS (SELECT key, 0, pos, leaf, n FROM p {climb.format(t="tree")}),
        tops AS (SELECT key, h, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        over_(key, lvl, pos, h, n) AS (SELECT '', 0, pos, h, n FROM tops {climb.format(t="over_")}),
        sib AS (SELECT key, lvl, pos, n, {sides} FROM tree WHERE n > 1),
        sib2 AS (SELECT key, lvl, pos, n, {sides} FROM over_ WHERE n > 1),
        steps AS (SELECT p.key, p.pos, 0 AS part, s.lvl, s.l, s.r FROM p JOIN sib s ON s.key = p.key AND s.pos = p.pos >> (4 * s.lvl)
                  UNION ALL SELECT p.key, p.pos, 1, s.lvl, s.l, s.r FROM p JOIN tops t ON t.key = p.key JOIN sib2 s ON s.pos = t.pos >> (4 * s.lvl)),
        paths AS (SELECT key, pos, list({{'l': l, 'r': r, 'h': ''}} ORDER BY part, lvl) AS path, string_agg(l || r, '' ORDER BY part, lvl) AS all_ FROM steps GROUP BY key, pos),
        f AS (SELECT p.doc_id, p.leaf, t.h AS subroot, (SELECT h FROM over_ WHERE n = 1) AS root, sha256(coalesce(all_, '')) AS proof_sha256,
                     list_reduce(list_prepend({{'l': '', 'r': '', 'h': CASE WHEN p.chosen THEN p.low ELSE p.leaf END}}, coalesce(path, [])),
                                 lambda a, s: {{'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}}).h AS folded_root
              FROM p JOIN tops t ON t.key = p.key LEFT JOIN paths q ON q.key = p.key AND q.pos = p.pos)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""


def _resampling() -> str:
    of = lambda t: f"""(SELECT r, unnest(ws) AS f FROM {t} UNION ALL
                        SELECT r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM {t})"""  # noqa: E731
    return f"""
        WITH RECURSIVE {_CRC_TABLE.strip()},
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT row_number() OVER () AS r, {_WORDS} AS ws FROM benchmark),
        df AS (SELECT r, f, count(*) AS c FROM {of("d")} GROUP BY r, f),
        bf AS (SELECT f, count(*) AS c FROM {of("b")} GROUP BY f),
        known AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
        s AS (SELECT bucket, sum(c) AS n FROM df JOIN known USING (f) GROUP BY bucket),
        t AS (SELECT bucket, sum(c) AS n FROM bf JOIN known USING (f) GROUP BY bucket),
        g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
                                               / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
              FROM s LEFT JOIN t ON t.bucket = s.bucket),
        w AS (SELECT r, sum(c)::BIGINT AS n, floor(sum(c * gain)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight FROM df JOIN known USING (f) JOIN g USING (bucket) GROUP BY r),
        x AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
                     ('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w ON w.r = d.r),
        y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
        z AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS k, count(*) OVER () * 25 // 100 AS most FROM y WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM z
        UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM y WHERE n_words < 20"""


def _licences(rare_words: int = 6, least_votes: int = 2, least_share: float = 0.5) -> str:
    known = notices(NOTICES)
    words = ", ".join(f"({n.number}, '{n.label}', {k}, '{w}', {int(k in n.must)})" for n in known for k, w in enumerate(n.words))
    base = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())
    return f"""
        WITH n(number, label, pos, word, must) AS (VALUES {words}),
        phrases(label, ws) AS (VALUES {base}),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
        o AS (SELECT r, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS word FROM d),
        base AS (SELECT o.r, o.place, p.label FROM o JOIN phrases p ON p.ws[1] = o.word JOIN d ON d.r = o.r AND list_slice(d.ws, o.place + 1, o.place + len(p.ws)) = p.ws),
        hits AS (SELECT * FROM o WHERE word IN (SELECT word FROM n)),
        own AS (SELECT DISTINCT r, word FROM hits),
        idf AS (SELECT word, count(*) AS files FROM own GROUP BY word),
        may AS (SELECT own.r, m.number FROM own JOIN (SELECT DISTINCT number, word FROM n WHERE must = 1) m USING (word) GROUP BY own.r, m.number
                HAVING count(*) = (SELECT count(DISTINCT word) FROM n k WHERE k.must = 1 AND k.number = m.number)),
        looked AS (SELECT * FROM (SELECT may.r, may.number, own.word, row_number() OVER (PARTITION BY may.r, may.number ORDER BY files, own.word) AS k
                                  FROM may JOIN own USING (r) JOIN idf USING (word) WHERE EXISTS (SELECT 1 FROM n WHERE n.number = may.number AND n.word = own.word)) WHERE k <= {rare_words}),
        votes AS (SELECT l.r, l.number, h.place - n.pos AS shift FROM looked l JOIN hits h ON h.r = l.r AND h.word = l.word JOIN n ON n.number = l.number AND n.word = l.word
                  GROUP BY ALL HAVING count(*) >= {least_votes}),
        met AS (SELECT v.r, n.number, v.shift, any_value(n.label) AS label, sum(n.must) AS must, count(*) AS c
                FROM votes v JOIN n ON n.number = v.number JOIN hits h ON h.r = v.r AND h.place = v.shift + n.pos AND h.word = n.word GROUP BY v.r, n.number, v.shift),
        good AS (SELECT met.r, met.label, met.c / k.size AS share FROM met JOIN (SELECT number, sum(must) AS musts, count(*) AS size FROM n GROUP BY number) k USING (number)
                 WHERE met.must = k.musts AND met.c / k.size >= {least_share}),
        b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
        g AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM good GROUP BY r)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
               array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ',') AS labels,
               greatest(CASE WHEN b.n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(g.share, 0))::DOUBLE AS score
        FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN g ON g.r = d.r"""


ORACLE = {"op11_merkle_manifest": _merkle(), "op12_importance_resampling": _resampling(), "op13_license_scan": _licences()}
