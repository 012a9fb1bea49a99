"""Documents with everything that may go wrong, for all operators."""

from pyspark.sql import types as T

LONG = " ".join(f"w{k % 977} x{k}" for k in range(60_000))

#: Ids, texts, languages and sources; rows repeat, ids repeat, columns hold nulls.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "b"),
    (6, LONG, "en", "a"),
    (None, "le renard brun saute par dessus le chien paresseux encore une fois", "fr", "c"),
    (7, "le renard brun saute par dessus le chien paresseux encore une fois", "fr", None),
    (8, "1234 5678 !!! ###", "en", "a"),
    (9, "one two", None, "c"),
    (9, "another text under the same number", "en", "c"),
    (10, "naïve café — “quoted” 日本語 ½ <|endoftext|> It's O'Clock", "fr", "a"),
]

#: Extra columns with names that operators use themselves.
EXTRA = ["_id", "_text", "_hash", "node", "label", "kept", "group_size", "piece", "length", "score", "sampled", "text_hash"]


def odd_documents(spark, rows=ROWS):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType())]
    fields += [(c, T.LongType()) for c in EXTRA]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return spark.createDataFrame([(*r, *[k] * len(EXTRA)) for k, r in enumerate(rows)], schema).repartition(3)


def empty(spark):
    return odd_documents(spark).where("1 = 0")
