"""Requested documents by path."""

from factspan.sources import documents


def test_document_lookup_does_not_multiply_requests_and_documents(spark, monkeypatch):
    """Three hundred requests for one path that three hundred documents share."""
    paths = spark.createDataFrame(
        [(f"r{n}", "/w/a.cs", "p1" if n % 2 else None) for n in range(300)] + [("rel", "b.cs", None), ("none", "c.cs", None), ("other", "/w/a.cs", "p9")],
        "request_id string, request_path string, request_project string",
    )
    docs = spark.createDataFrame(
        [(f"d{n:03}", "/w/a.cs", f"p{n % 2}") for n in range(300)] + [("e1", "/w/b.cs", None), ("e0", "/w/b.cs", "p1")], "doc_id string, path string, project string"
    )
    sizes, first = [], documents.dedupe_first
    monkeypatch.setattr(documents, "dedupe_first", lambda df, keys, order: (sizes.append(df.count()), first(df, keys, order))[1])
    rows = {r.request_id: (r.path, r.project, r.doc_id) for r in documents.document_lookup(paths, documents.document_index(docs, "/w")).collect()}
    assert rows["r0"] == ("/w/a.cs", "p0", "d000") and rows["r1"] == ("/w/a.cs", "p1", "d001")
    assert rows["rel"] == ("/w/b.cs", None, "e1") and rows["none"] == rows["other"] == (None, None, None)
    assert len(rows) == 303 and max(sizes) <= 303


def test_document_lookup_repeated_request_takes_the_best_of_its_paths(spark):
    paths = spark.createDataFrame([("r", "b", None), ("r", "/w/a", None), (None, "/w/a", None)], "request_id string, request_path string, request_project string")
    docs = spark.createDataFrame([("d1", "/w/a", "p"), ("d2", "/w/b", "p")], "doc_id string, path string, project string")
    rows = documents.document_lookup(paths, documents.document_index(docs, "/w")).collect()
    assert sorted((r.request_id or "", r.request_path, r.doc_id or "") for r in rows) == [("", "/w/a", ""), ("r", "/w/a", "d1"), ("r", "b", "d1")]
