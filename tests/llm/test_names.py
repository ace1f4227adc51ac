"""Column names with dots and backticks pass through the stages that carry whole rows."""

from graphquarry.llm import common, quality, secrets


def test_odd_column_names(spark):
    rows = [(i, f"text {i} password=abcdef{i} " * 5, "en", "s", 9, 1, 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and {(r["a.b"], r["c`d"]) for r in masked.collect()} == {(1, 2)}
    assert quality.keep_good(docs, labels, 0.0).columns == docs.columns
    verdict = docs.select("doc_id", common.text_hash().alias("text_hash")).selectExpr("doc_id", "text_hash", "doc_id < 7 AS stays")
    kept = common.keep_rows(docs, verdict)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(7))
