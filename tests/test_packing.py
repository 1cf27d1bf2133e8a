import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import index, packing, store


@pytest.mark.parametrize(("folders", "files"), [(1, 1), (8, 3)])
def test_packed_parts_hold_the_postings_in_order(spark, monkeypatch, folders, files):
    monkeypatch.setattr(packing, "OUT_ROWS", 7)
    monkeypatch.setattr(packing, "OUT_PLACES", 20)
    draw = random.Random(5)
    rows = [(draw.randrange(-(1 << 62), 1 << 62), " ".join(draw.choice("a b é ß 日本 😀 ﬁ İ zz".split()) for _ in range(draw.randrange(60)))) for _ in range(40)]
    rows += [(None, "a b a"), (-1, ""), (-2, None), (-3, "b, b \\ x-y"), (-4, " ".join(f"w{i % 137}" for i in range(900)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    dealt = packing.packed(docs, folders, files).repartitionById(folders * files, F.col("part"))
    found = packing.unpacked(dealt, files).withColumn("task", F.spark_partition_id()).withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(files))).withColumn("right", store.bucket(F.col("term"), folders)).collect()
    plain = {(r.term, r.doc_id): r for r in index.postings(docs).collect()}
    lengths = {r.doc_id: r.dl for r in index.doc_stats(docs).collect()}
    assert len(found) == len(plain)
    most = {d: max(r.tf for (_, e), r in plain.items() if e == d) for _, d in plain}
    for r in found:
        same = plain[r.term, r.doc_id]
        assert (r.tf, r.positions, r.dl, r.max_tf) == (same.tf, same.positions, lengths[r.doc_id], most[r.doc_id])
        assert r.bucket == r.right and r.task == r.bucket * files + r.file
    for task in {r.task for r in found}:
        own = [(r.term.encode(), r.doc_id is not None, r.doc_id or 0) for r in found if r.task == task]
        assert own == sorted(own)


def test_order_without_room_in_the_key():
    import numpy as np

    doc, term = np.array([0, 0, 0, 1 << 40, 1 << 40]), np.array([5, 2, 5, (1 << 20) - 1, 2])
    first, order = packing.sorted_runs(doc, term, np.arange(5))
    assert order.tolist() == [1, 0, 2, 4, 3] and first.tolist() == [0, 1, 3, 4]


def test_java_has_the_same_delimiters(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["\ufeff", "\U0001f600"]
    docs = spark.createDataFrame([(f"a{c}b",) for c in chars], "text string")
    for keep in ("", ",.-^]&["):
        cut = lambda p: F.split("text", p, -1)
        assert docs.where(cut(text.delimiters(keep)) != cut(text.java_delimiters(keep))).count() == 0
    assert docs.where(F.size(F.split("text", text.java_delimiters(), -1)) == 2).count() == len(text.PUNCTUATION) + 25


def test_tf_modes_join_nothing(spark):
    from lodestone import queries

    plan = queries.QUERIES["tf_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_trie_len_and_vectors_shuffle_no_postings(spark):
    from lodestone import queries

    plan = lambda q: queries.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in plan("trie_len") and "positions" not in plan("trie_len")
    assert "strategy=broadcast" in plan("vector_top_terms")


def test_stems_come_in_bounded_batches(spark):
    docs = spark.createDataFrame([(1, "relational ponies"), (2, None)], "doc_id bigint, text string")
    assert [r.t for r in index.tokenised(docs, stem=True).orderBy("doc_id").collect()] == [["relat", "poni"], []]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 4000
