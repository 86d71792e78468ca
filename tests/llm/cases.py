"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for river stone bread lamp garden winter copper violet harbor meadow candle orchard".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 2654435761 + 12345, []
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + (str((x >> 40) % 97) if (x >> 50) % 3 == 0 else "") + (".\n" if i % 17 == 16 else ""))
    return " ".join(out)


def odd_rows() -> list[tuple]:
    base = prose(1, 200)
    return [
        (0, base, "en", "s0", 1),
        (1, base, "en", "s0", 1),
        (2, base.replace("river", "rivers", 1), "en", "s1", None),
        (3, None, None, None, None),
        (4, "", "en", "s1", 0),
        (5, " \t\n  ", "fr", "s1", 0),
        (6, "Ünïcödé Straße İstanbul ﬁ ǅ 你好 🙂🙂 don't <|endoftext|> é", "de", "s2", 5),
        (7, "a" * 5000, "en", "s2", 5),
        (8, prose(3, 3000), "en", "s0", 1),
        (9, prose(9, 60) + " " + base[100:900] + " " + prose(10, 60), "en", "s0", 1),
        (9, prose(11, 40), "en", "s0", 1),
        (12, "one two three", "es", "s3", 1),
        (12, "one two three", "es", "s3", 1),
        (-5, prose(5, 30) * 3, "es", "s3", 1),
        (None, "id is missing here", "en", None, None),
    ]


def odd(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), SCHEMA).select("*", F.lit(1).alias("TEXT"), F.lit("x").alias("score"), F.lit("y").alias("ids"), F.lit("z").alias("Doc_Id"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
