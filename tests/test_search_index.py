"""The persisted BM25 index against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import search, search_index

QUERIES = [("a", "w1 w2 w3"), ("b", "w1"), ("c", "w40 w1 w1"), ("d", "nothing here"), ("e", "de la"), ("f", "w60 w61 w62 w63 w2")]


def documents(spark, n=400, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(80)], k=rnd.randint(0, 60)))) for i in rnd.sample(range(10 * n), n)]
    return spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "w1 " * 500)], "doc_id long, text string").repartition(5, "doc_id")


def rows_of(df):
    return [(r.query_id, r["rank"], r.document_id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]


def test_index_finds_what_scoring_everything_finds(spark, tmp_path):
    docs = documents(spark)
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    index = search_index.build_index(docs.filter("doc_id % 3 = 0"), "doc_id", "text", str(tmp_path / "i"), buckets=8, strip=16, block=4)
    index.append(docs.filter("doc_id % 3 <> 0"), "doc_id", "text", strip=32, block=3)
    index.append(docs.filter("doc_id > 1e9"), "doc_id", "text")  # an empty one
    for k in (1, 3, 10):
        assert rows_of(index.search(queries, k)) == rows_of(search.bm25_search(docs, queries, "doc_id", "text", k))
    assert index.segments().agg(F.sum("n")).first()[0] == docs.count()
    opened = search_index.Index(spark, str(tmp_path / "i"), 8)
    assert rows_of(opened.search(queries, 2, 1.2, 0.3)) == rows_of(search.bm25_search(docs, queries, "doc_id", "text", 2, 1.2, 0.3))


def test_search_reads_asked_buckets_only(spark, tmp_path):
    index = search_index.build_index(documents(spark), "doc_id", "text", str(tmp_path / "i"), buckets=16, strip=64)
    asked = index.postings(["w1", "w2"])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    read = asked.select(F.input_file_name().alias("f")).distinct().collect()
    assert 1 <= len({r.f.split("bucket=")[1].split("/")[0] for r in read}) <= 2


def test_maxima_bound_every_posting(spark, tmp_path):
    index = search_index.build_index(documents(spark), "doc_id", "text", str(tmp_path / "i"), buckets=2, strip=32, block=8)
    for r in index.postings([f"w{i}" for i in range(80)]).collect():
        assert r.n == len(r.documents) == len(r.tfs) <= 8
        peaks = {p["tf"]: p["length"] for p in r.peaks}
        assert all(peaks[tf] <= length for tf, length in zip(r.tfs, r.lengths)) and set(peaks) == set(r.tfs)


def test_failed_append_leaves_nothing(spark, tmp_path):
    docs = documents(spark, 60)
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    index = search_index.build_index(docs, "doc_id", "text", str(tmp_path / "i"), strip=8)
    before = rows_of(index.search(queries))
    index.spark.read.parquet(f"{index.path}/postings/segment=0").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=1")  # as if ended before its last write
    assert rows_of(index.search(queries)) == before
    assert index._next() == 1


def test_empty_index(spark, tmp_path):
    empty = documents(spark).filter("doc_id > 1e9")
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert search_index.build_index(empty, "doc_id", "text", str(tmp_path / "i")).search(queries).collect() == []


def test_an_index_is_not_built_over_another(spark, tmp_path):
    docs = documents(spark, 30)
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    search_index.build_index(docs, "doc_id", "text", str(tmp_path / "i"), buckets=2)
    with pytest.raises(FileExistsError):
        search_index.build_index(docs, "doc_id", "text", str(tmp_path / "i"), buckets=2)
    again = search_index.build_index(docs.filter("doc_id > 0"), "doc_id", "text", str(tmp_path / "i"), buckets=2, overwrite=True)
    assert rows_of(again.search(queries)) == rows_of(search.bm25_search(docs.filter("doc_id > 0"), queries, "doc_id", "text"))


def test_copies_tie_whatever_order_their_terms_come_in(spark, tmp_path):
    """Terms lie in files of the reverse order of sizes in the second segment; copies in both have one score, so the first ids win."""
    words = [f"w{i}" for i in range(6)]
    copied = " ".join(words) + " w1 w3 w3"
    copies = [(i, copied) for i in range(40)]
    # Documents of one word, of each word as often in one segment as its mirror in the other.
    others = [(100 + 2 * (4_000 * w + i) + side, words[w] + " and" * (i % 7)) for side in (0, 1) for w in range(6) for i in range(600 * (w if side else 5 - w))]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string").repartition(2, "doc_id")
    asked = [copied, "w0 w1 w2 w3 w4 w5", "w0 w2 w5", "w1 w3 w4 w4 w5", "w0 w3 w4 w5 w5"]
    queries = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "query_id string, query string")
    index = search_index.build_index(docs.filter("doc_id % 2 = 0"), "doc_id", "text", str(tmp_path / "i"))
    index.append(docs.filter("doc_id % 2 <> 0"), "doc_id", "text")
    found = index.search(queries, 30).collect()
    for q in range(len(asked)):
        mine = sorted((r["rank"], r["document_id"], r["score"]) for r in found if r["query_id"] == f"q{q}")
        assert [i for _, i, _ in mine] == list(range(30)) and len({score for _, _, score in mine}) == 1
