"""The pipeline's stages on odd rows, clashing columns and an empty table."""

import corpus_pipeline
from shoalcount.session import materialize

MORE = "kept boolean, digest string, position bigint, component_id bigint"


def test_odd_rows_and_clashing_columns(spark, sf):
    schema = f"{spark.read.parquet(f'{sf}/documents.parquet').select('doc_id', 'text', 'lang', 'source')._jdf.schema().toDDL()}, {MORE}"
    clean = "The committee met on Tuesday to agree the new timetable for the harbour and the railway."
    rows = [
        (None, None, None, None), (2, None, "en", "a"), (3, "", None, "a"), (4, clean, "en", None), (5, clean.upper(), "en", "b"), (6, clean, "en", "b"),
        (7, "one", "xx", "c"), (7, "one", "xx", "c"), (8, clean * 2000, "en", "c"),
    ]
    docs = spark.createDataFrame([(*r, True, "d", 0, 0) for r in rows], schema)
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        held.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    judged, exact, near, mixed, encoded = (sorted(d.select("doc_id").toPandas()["doc_id"].dropna().astype(int)) for d in held)
    assert set(judged) <= {2, 3, 4, 5, 6, 7, 8} and 7 in judged
    # of equal texts the largest doc_id stays; null and empty are one text, and repeated rows are one
    assert exact == [i for i in sorted(set(judged)) if not any(j > i and {i, j} in ({2, 3}, {4, 5}, {4, 6}, {5, 6}) for j in judged)]
    assert set(near) <= set(exact) and mixed == near and encoded == mixed


def test_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        assert docs.count() == 0
