from __future__ import annotations

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def edge_rows():
    """Nulls, empty and blank texts, repeated rows, a very long text, odd characters."""
    long = " ".join(f"word{i % 977} x{i % 31}" for i in range(40_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Two Words"), (5, "Two Words"), (6, long), (7, "ÄÖ ß 日本語 🙂 ſ K"),
        (None, "no id here"), (8, "a" * 30_000), (9, "1" * 30_000), (10, "@" * 5_000 + "." * 5_000), (11, "<|endoftext|> it's  x y"), (12, "=" * 20_000 + ":" * 20_000),
    ]


def keyed(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)
