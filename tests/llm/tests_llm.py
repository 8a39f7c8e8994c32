"""Inputs for the tests of this folder."""


def odd_documents(spark, rows):
    """Documents with null ids and texts, empty and repeated rows, and columns with clashing names."""
    rows = [(None, None), (None, ""), (5, ""), (5, None), *rows]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", 7, 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, piece int, row int")
