"""The whole pipeline against a plain single-process version on a small fixture: sf0.001 and planted rows."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestone.llm import language_id, quality_classifier

SF = "/root/testdata/sf0.001"


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality_model(docs, labels):
    known = {}
    for doc_id, y in labels:
        if fold(doc_id, 5) != 0:
            known[doc_id] = max(y, known.get(doc_id, y))
    rows = sorted((d, list(map(float, quality_classifier.features(t))), known[d]) for d, t, _ in docs if d in known)
    return quality_classifier.fit(np.array([x for _, x, _ in rows]), np.array([y for _, _, y in rows]))


def language_model(docs):
    rows = sorted((lang, language_id.features(t).astype(np.float16).tobytes()) for d, t, lang in docs if d is not None and fold(d, 4) != 2 and lang and t)
    return language_id.fit(np.array([np.frombuffer(x, np.float16) for _, x in rows], np.float32), [lang for lang, _ in rows])


def without_copies(docs):
    """Flood fill over all pairs: of each group one row with the smallest id stays, null ids last."""
    sets = []
    for _, t, _ in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(t)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    group = [None] * len(docs)
    for start in range(len(docs)):
        todo = [] if group[start] is not None else [start]
        while todo:
            i = todo.pop()
            if group[i] is None:
                group[i] = start
                todo += [j for j in range(len(docs)) if group[j] is None and linked(sets[i], sets[j])]
    best = {}
    for k, (g, (d, _, _)) in enumerate(zip(group, docs, strict=True)):
        best[g] = min(best.get(g, (True, 0, k)), (d is None, d or 0, k))
    return [row for k, (g, row) in enumerate(zip(group, docs, strict=True)) if best[g][2] == k]


def is_clean(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    flat = " " + " ".join(words(text)) + " "
    for item in items:
        w = words(item)
        if w and any(f" {' '.join(w[i : i + 10])} " in flat for i in range(max(1, len(w) - 9))):
            return False
    return True


def test_run_against_brute_force(spark, tmp_path):
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pandas()
    long = docs.loc[(docs.n_chars > 600) & (docs.n_chars < 4000)].iloc[:6]
    passage = max(items.text.dropna(), key=len)
    planted = [(9001, long.text.iloc[0]), (9002, long.text.iloc[1] + " end"), (9003, long.text.iloc[2] + " " + passage), (9004, None), (9005, ""), (9006, "12 ! 34"), (9007, long.text.iloc[3]), (9007, long.text.iloc[3]), (None, long.text.iloc[4] + " and more words here")]
    docs = pd.concat([docs, pd.DataFrame([{"doc_id": d, "text": t, "lang": "en", "source": "planted", "n_chars": len(t or "")} for d, t in planted])]).astype({"doc_id": "Int64"})
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in docs.itertuples()]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    left = [(d, t, lang) for d, t, lang, _, _ in rows]
    counts = [len(left)]
    labels = [(r.doc_id, r.quality) for r in pq.read_table(f"{SF}/labels.parquet").to_pandas().dropna(subset=["doc_id", "quality"]).itertuples()]
    quality = quality_model(left, labels)
    left = [r for r in left if quality.score(np.array([quality_classifier.features(r[1])]))[0] >= quality_classifier.CUT]
    counts.append(len(left))
    language = language_model(left)
    found = [language.predict(t) for _, t, _ in left]
    left = [r for r, (lang, score) in zip(left, found, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_MARGIN]
    counts.append(len(left))
    left = without_copies(left)
    counts.append(len(left))
    left = [r for r in left if is_clean(r[1], items.text.tolist())]
    counts.append(len(left))
    pieces = library.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = sorted(((d, pieces.encode(t), hashlib.sha256(t.encode()).hexdigest()) for d, t, _ in left), key=repr)

    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "tokens", "text_sha256").collect()
    assert sorted(((r.doc_id, list(r.tokens), r.text_sha256) for r in out), key=repr) == want
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] > 0  # the decisions of the fixture take effect


def test_language_stage_drops_unlearnt_languages(spark):
    strange = [
        "Вчера вечером в городе состоялась большая встреча жителей, на которой обсуждали строительство новой школы",
        "Wczoraj wieczorem w mieście odbyło się duże spotkanie mieszkańców, na którym omawiano budowę nowej szkoły",
        "Eilen illalla kaupungissa pidettiin suuri asukkaiden kokous, jossa keskusteltiin uuden koulun rakentamisesta",
        "昨日の夜、町で新しい学校の建設について大きな会議が開かれました",
        "#### $$ 1234 !!! ??? x %%% @@@ 000 ---- ==== 77 88 99 ++",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-k, t, None) for k, t in enumerate(strange, 1)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()}


def test_batches_are_small_and_heaps_are_handed_back(spark):
    from lodestone.llm import common

    common.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    common.shrink_heaps(spark)
    assert beans() > before
