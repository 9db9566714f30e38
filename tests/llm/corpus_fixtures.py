"""Small tables that the corpus tests share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9))) for _ in range(n))


def documents(spark, texts, first=1):
    """Documents with ids from ``first`` on; an id can be given as (id, text)."""
    rows = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (first + k, t)
        rows.append((i, t, "en", f"s{k % 3}", len(t or "")))
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with extra columns named like the ones operators use inside."""
    from pyspark.sql import functions as F

    for name in ("rank", "email", "base", "h", "key", "words", "tkey", "bands", "score", "slots", "p", "block", "spans"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, *keys):
    return sorted((tuple(r) for r in (df.select(*keys) if keys else df).collect()), key=repr)
