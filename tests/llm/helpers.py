"""Small tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def odd_docs(spark):
    """NULLs, an empty and a blank text, repeated rows, characters beyond the first plane."""
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "no id here at all"), (5, "a\U0001f600b \x00 c"), (6, "x" * 5000)])


def with_clashes(df, *names):
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("old"))
    return df.withColumn("extra", F.lit(7))
