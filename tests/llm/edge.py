"""Tables with nulls, empty and long texts, ties, repeats and columns of any name."""


LONG = "word other thing " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, node long, size string, copies int, row string, hash int, chunk string"
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "same words here again\nand here", "en", "b"), (4, "same words here again\nand here", "en", "b"), (5, "same words here again\nand here", None, None), (None, "a row without an id", "de", "c"), (None, None, None, None), (6, LONG, "en", "a"), (7, "12345 !!! ???", "fr", None), (8, "x", "fr", "ä"), (9, "\x00 nul and \U0001f44d", "en", "a")]


def docs(spark, rows=ROWS):
    full = [(i, t, lang, s, 0 if t is None else len(t), "k", 1, 2, "s", 3, "r", 4, "c") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return docs(spark, [])


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def by_id(df):
    return df.orderBy("doc_id").toPandas()


