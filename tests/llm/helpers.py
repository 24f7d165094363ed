DOC = "doc_id long, text string, lang string, source string, n_chars long, pos long, size long"


def docs(spark, texts, first=0):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 7, -1) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOC)


EDGE = [None, "", " ", "\n\t", "x", "one two", "one two", "a b c d e f " * 4000, "émile straße ÀÉ", None, "l" * 5000]
