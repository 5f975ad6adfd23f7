"""Where queries are registered, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.inputs import select

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL whose {input} names stand for the inputs' SELECTs."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name in (
                "turns", "lyrics", "frames", "spells", "captions", "candidates", "axis", "probes", "raw_starts", "vectors", "payloads",
                "records", "entries", "targets", "texts", "songs", "catalog", "wanted", "ballads"
            ):
                text = text.replace("{" + name + "}", select(name))
            ORACLE[f.__name__] = text
        return f

    return put


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})
