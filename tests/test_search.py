import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.engine import Config, Engine
from lodestone.functions import text
from lodestone.operators import index, sentiment, store
from lodestone.plans import boolean
from lodestone.sources import csv_to_xml, files
from lodestone.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_tokenise_edge_cases(spark):
    rows = ["a\\b c", "\\ x", "It's U.S.-led, [ok] x_y", "a b c", "", None, "a\u001cb"]
    found = spark.createDataFrame([(r,) for r in rows], "text string").select(text.tokens(F.col("text")).alias("t")).collect()
    assert [r.t for r in found] == [text.tokenise(r or "") for r in rows]
    assert found[0].t == ["a\\b", "c"] and found[2].t == ["it", "s", "u", "s", "led", "ok", "x", "y"] and found[3].t == ["a", "b", "c"]
    assert text.tokenise("a,b.c", keep=",.") == ["a,b.c"]


def test_posting_arrays(spark):
    row = spark.range(1).select(
        index.insert(F.array(F.lit(1), F.lit(3)), F.lit(2)).alias("a"),
        index.shift(F.array(F.lit(2), F.lit(3), F.lit(4)), 1).alias("b"),
        index.intersect(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(3), F.lit(4))).alias("c"),
        index.union(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("d"),
        index.shown(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e"),
    ).first()
    assert tuple(row) == ([1, 2, 3], [1, 2, 3], [2, 3], [1, 2, 3], "1 --> 2 --> 3")


def test_precedence():
    t = lambda w: boolean.Terms((w,))
    assert boolean.parse("a OR b AND c") == boolean.Both(boolean.Either(t("a"), t("b")), t("c"))
    assert boolean.parse("work AND NOT industry AND times") == boolean.Without(t("work"), (boolean.Both(t("industry"), t("times")),))
    assert boolean.parse("year OR NOT previous OR democracy") == boolean.Either(t("year"), boolean.Either(boolean.Not(("previous",)), t("democracy")))
    assert boolean.parse("NOT today NOT evidence") == boolean.Not(("today", "evidence"))
    assert boolean.parse("#10(year, commission)") == boolean.Near(("year", "commission"), 10)
    with pytest.raises(ValueError):
        boolean.parse("#x(a)")


def test_phrase_and_proximity_against_naive(spark):
    draw = random.Random(3)
    texts = {k: [draw.choice("abcd") for _ in range(draw.randrange(0, 25))] for k in range(60)}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id bigint, text string")
    for phrase in ("a a", "a b a", "c d"):
        p = phrase.split()
        want = {k: s for k, v in texts.items() if (s := [i for i in range(len(v)) if v[i : i + len(p)] == p])}
        assert {r.doc_id: r.positions for r in boolean.evaluate(f'"{phrase}"', docs).collect()} == want
    for n, words in ((1, "a b"), (3, "a b c")):
        near = {k for k, v in texts.items() if any(set(words.split()) <= set(v[i : i + n + 1]) for i in range(len(v)))}
        assert {r.doc_id for r in boolean.evaluate(f"#{n}({words.replace(' ', ', ')})", docs).collect()} == near


def test_porter():
    stem = text.Porter()
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "relational", "conflated", "agreed", "happy", "controll")] == ["caress", "poni", "hop", "relat", "conflat", "agre", "happi", "control"]


def test_ingest_equals_batch(spark, tmp_path):
    schema = "doc_id bigint, headline string, text string"
    first = spark.createDataFrame([(1, "", "a b a"), (2, "", "b c"), (4, None, None)], schema)
    more = spark.createDataFrame([(1, "", "a b a"), (2, "", "changed b d"), (3, "h", "new")], schema)
    whole = spark.createDataFrame([(1, "", "a b a"), (2, "", "changed b d"), (3, "h", "new"), (4, None, None)], schema)
    for rows in (first, more):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in")
        ingest.ingest(stream, f"{tmp_path}/index", f"{tmp_path}/ck").awaitTermination()
    found, want = store.load(spark, f"{tmp_path}/index"), store.build(whole, f"{tmp_path}/want")
    assert len(found.at) == 2
    ingest.append(more, f"{tmp_path}/index", found.at[-1])  # a batch that is run again replaces what it left
    for name in ("postings", "lexicon", "doc_stats", "corpus_stats"):
        rounded = lambda s: sorted([tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in getattr(s, name)().collect()])  # noqa: B023, E731
        assert rounded(found) == rounded(want), name
    assert {r.doc_id: r.text for r in ingest.texts(spark, f"{tmp_path}/index", schema).collect()} == {1: "a b a", 2: "changed b d", 3: "new", 4: None}
    engine = Engine(ingest.texts(spark, f"{tmp_path}/index", schema), f"{tmp_path}/index")
    assert [r.doc_id for r in engine.match("changed").collect()] == [2] and engine.match("c").count() == 0
    assert [r.content for r in engine.search("new").collect()] == ["...h <b>new</b>..."]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(k, f"Title {k}", f"the plain house number {k} stands by the river " + "and so on " * k, f"https://news.example/{k}", "2024-02-19T00:00", "The Guardian") for k in range(1, 13)] + [(20, None, None, None, None, None)]
    made = Engine(spark.createDataFrame(rows, "doc_id bigint, headline string, text string, url string, date string, publisher string"))
    made.build(str(tmp_path_factory.mktemp("index")))
    return made


def test_engine_without_words(engine):
    for query in ("", "   ", '""', "#2()", "NOT qqq AND \"\""):
        assert engine.match(query).count() == 0 and engine.search(query).count() == 0
    assert engine.ranked(" ").count() == 0 and engine.match("qqq zzz").count() == 0
    assert engine.match("  NOT house ").select("doc_id").collect()[0].doc_id == 20


def test_engine_results(engine):
    cards = engine.search("house AND river").collect()
    assert [r.doc_id for r in cards] == [1, 2, 3, 4, 5]
    assert cards[0].title == "Title 1" and cards[0].date == "2024-02-19" and cards[0].image == "https://www.google.com/s2/favicons?sz=64&domain_url=theguardian.com"
    assert cards[0].content == "...title 1 the plain house number 1 stands by the <b>river</b> and so on..."
    assert engine.search("house").first().content == "the plain house number 1 stands by the river and so on"  # no position beyond the title's characters: the body's first tokens
    assert engine.search("river").first().content.count("<b>river</b>") == 1
    assert engine.ranked("house 7").first().doc_id == 7
    engine.config.mode = "vsm"
    try:
        assert engine.ranked("7").collect()[0].doc_id == 7 and engine.ranked("7").count() == 13  # documents without the word score 0
    finally:
        engine.config.mode = "tfidf"
    assert engine.expanded("7").first().doc_id == 7
    table = engine.spark.createDataFrame([("home", "house")], "word string, synonym string")
    assert engine.expanded("home", "syn", table).count() == engine.ranked("home house").count() == 12


def test_feedback_divides_by_the_documents_taken(engine):
    from lodestone.operators import rank

    vector = {r.term: r.weight for r in rank.feedback(engine.store, engine.docs, "7", first=5).collect()}
    one = {r.term: r.weight for r in rank.feedback(engine.store, engine.docs, "7", first=1).collect()}
    query = {r.term: r.qw for r in rank.query_vector(engine.store, "7").collect()}
    assert vector["7"] - query["7"] == pytest.approx((one["7"] - query["7"]) / 5)


def test_did_you_mean(engine):
    found = engine.did_you_mean("teh hosue AND (river)")
    assert found.changed and found.text == "the house AND (river)" and found.corrections == [("teh", "the"), ("hosue", "house")]
    assert engine.did_you_mean("house") == ("house", [], False) and not engine.did_you_mean("").changed


def test_config(tmp_path):
    (tmp_path / "x.ini").write_text("[search]\nresults = 7\nmode = bm25\n[log]\nmemory = true\n")
    config = Config.read(str(tmp_path / "x.ini"))
    assert (config.get("results"), config.mode, config.log["memory"]) == (7, "bm25", True) and "results = 7" in config.show()


def test_empty_corpus(spark, tmp_path):
    empty = Engine(spark.createDataFrame([], "doc_id bigint, headline string, text string"), config=Config(mode="vsm"))
    assert empty.match("a").count() == empty.ranked("a").count() == empty.search("a").count() == 0
    with pytest.raises(ValueError):
        files.non_empty(empty.docs)
    with pytest.raises(ValueError):
        store.load(spark, f"{tmp_path}/none")


def test_modes_against_naive(spark):
    import math

    from lodestone.operators import rank

    texts = {1: "a a b c", 2: "a c c c d", 3: "e e", 4: "b e a"}
    made = store.build(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    tf = {k: {w: t.split().count(w) for w in set(t.split())} for k, t in texts.items()}
    df = {w: sum(w in t for t in tf.values()) for t in tf.values() for w in t}
    n, lbar = len(texts), sum(len(t.split()) for t in texts.values()) / len(texts)
    idf = {"n": lambda d: 1, "t": lambda d: math.log10(n / d), "p": lambda d: 0 if d >= n else max(0, math.log10((n - d) / d))}
    weigh = {"n": lambda x, m: x, "l": lambda x, m: 1 + math.log10(x), "a": lambda x, m: 0.5 + 0.5 * x / m}
    query = {"a": 2, "c": 1, "zz": 1}
    for mode, t, i in [("tfidf", t, i) for t in "nla" for i in "ntp"] + [("bm25", "l", "t")]:
        if mode == "bm25":
            cell = lambda x, length, d, m: x / (1.5 * length / lbar + x + 0.5) * math.log10((n - d + 0.5) / (d + 0.5))
        else:
            cell = lambda x, length, d, m: weigh[t](x, m) * idf[i](d)  # noqa: B023, E731
        q = {w: cell(x, lbar, df[w], max(query.values())) for w, x in query.items() if w in df}
        want = {}
        for k, own in tf.items():
            v = {w: cell(x, sum(own.values()), df[w], max(own.values())) for w, x in own.items()}
            size = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in q.values()))
            want[k] = sum(v.get(w, 0) * x for w, x in q.items()) / size if size else 0
        found = {r.doc_id: r.score for r in rank.vsm(made, "A a c zz", mode, t, i).collect()}
        assert found == pytest.approx(want), (mode, t, i)


def test_trie(spark):
    words = index.trie_words(spark.createDataFrame([("magic", 7, 0), ("the", 5, 1), ("there", 6, 2), ("the", 8, 3)], "word string, index_id bigint, seq bigint"))
    assert tuple(index.trie_search(words, "the").first()) == ("the", 8, 2) and index.trie_contains(words, "magic") and not index.trie_contains(words, "mag")
    assert [r.word for r in index.trie_traverse(words).collect()] == ["magic", "the", "there"] and index.trie_len(words).first().size == 4
    assert index.trie_len(words.where("false")).first().size == 0


def test_files(spark, tmp_path):
    news = spark.createDataFrame([(1, "2024-01-02", 'A "T" <b>', "One\ntwo", "The Daily Post", "lead", "ann", "news", "u1", "LEFT"), (2, "2024-01-01", "B", "Three", "Post", "", None, "", "u2", "")], files.NEWS)
    for r in files.rendered(news).collect():
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "pages" / f"news_{r.doc_id}.html").write_text(r.html)
    found = files.html_files(spark, [str(tmp_path / "pages")])
    parsed = files.html_documents(found, "path").orderBy("doc_id").collect()
    assert [(r.headline, r.text) for r in parsed] == [('A "T" <b>', "One two"), ("B", "Three")]
    page = files.html_page(spark, str(tmp_path / "pages"), 1).first()
    assert "Written by: ann" in page.html and 'meta name="lead_paragraph"' in page.html and 'charset="utf-8"' in page.html
    assert files.html_page(spark, str(tmp_path / "pages"), 3).count() == 0
    keep = str(tmp_path / "manifest")
    assert files.change_queue(found, keep, clear=True).count() == 2 and files.change_queue(found, keep).count() == 0
    (tmp_path / "pages" / "news_2.html").write_text("<h1>New</h1><p>x")
    now = files.html_files(spark, [str(tmp_path / "pages")])
    assert [r.path[-6:] for r in files.change_queue(now, keep, clear=True).collect()] == ["2.html"]
    assert files.load_manifest(spark, keep).count() == 2
    files.save_html(news, str(tmp_path / "out"))
    assert {r.outlet_key for r in spark.read.text(str(tmp_path / "out")).select("outlet_key").distinct().collect()} == {"post"}
    files.write_csv(news, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), files.NEWS).exceptAll(news).count() <= 1  # an empty string is read as null
    files.write_xml(news, str(tmp_path / "xml"))
    back = files.read_xml(spark, str(tmp_path / "xml"), "DOCNO bigint, DATE string, HEADLINE string, TEXT string")
    assert [tuple(r) for r in files.xml_to_rows(back, "DOCNO").orderBy("DOCNO").collect()] == [(1, "B", "Three"), (2, 'A "T" <b>', "One two")]
    missing = spark.createDataFrame([(" ", None)], "HEADLINE string, TEXT string")
    assert tuple(files.xml_to_rows(missing).first()) == ("No Title Found", "No Text Found")


def test_csv_to_xml_command(spark, tmp_path):
    (tmp_path / "n.csv").write_text('date,title,article\n2024-01-02,T,"x\ny"\n')
    assert csv_to_xml.main([]) == 1 and csv_to_xml.main([str(tmp_path / "n.csv"), str(tmp_path / "x")]) == 0
    assert files.read_xml(spark, str(tmp_path / "x"), "DOCNO bigint, HEADLINE string").collect() == [(1, "T")]


def test_feed(spark):
    value = '{"response": {"results": [{"webUrl": "u", "sectionName": "s", "fields": {"headline": "h", "bodyText": "b", "firstPublicationDate": "d"}, "tags": [{"type": "contributor", "webTitle": "x"}, {"type": "tone", "webTitle": "y"}]}]}}'
    rows = ingest.feed_articles(spark.createDataFrame([(value,), ("not json",), (None,)], "value string")).collect()
    assert [(r.date, r.title, r.article, r.outlet, r.authors, r.domain, r.url) for r in rows] == [("d", "h", "b", "guardian", "x", "s", "u")]


def test_html_fields_and_stems_fixed_vectors(spark):
    pages = spark.createDataFrame([(1, "<h1>A &amp; b</h1><script>var p='<p>no'</script><p>One <b>t</b>wo<p>Three</p><div>out"), (2, None), (3, "")], "page_id bigint, html string")
    assert [tuple(r) for r in files.html_documents(pages).orderBy("doc_id").collect()] == [(1, "A & b", "One two Three"), (2, "", ""), (3, "", "")]
    docs = spark.createDataFrame([(1, "Running ponies, relational hopping's"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.t for r in index.tokenised(docs, stem=True).collect()} == {1: ["run", "poni", "relat", "hop", "s"], 2: []}


def test_pieces(spark):
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    want = library.SentencePieceProcessor(model_file=path).encode("some news text", out_type=str)
    rows = spark.createDataFrame([("some news text",), (None,)], "text string").select(text.pieces(path)("text").alias("p")).collect()
    assert [r.p for r in rows] == [want, None]


def test_sentiment_held_out(spark):
    draw = random.Random(9)
    moods = ("good fine great happy nice".split(), "bad poor awful sad worse".split())
    said = lambda y: " ".join(draw.choice(moods[1 - y] if draw.random() < 0.3 else "the a of it was day".split()) for _ in range(30))
    rows = spark.createDataFrame([(said(k % 2), k % 2) for k in range(400)], "text string, sentiment int")
    train, test = sentiment.split(rows)
    found = sentiment.evaluate(sentiment.train(train), test)
    assert found["auc"] > 0.95 and found["accuracy"] > 0.9


@pytest.mark.parametrize("name", ["postings", "bool_or_not", "bool_empty", "rank_bm25", "vsm_cosine_tfidf", "prf_terms", "spell_correct", "snippet", "result_cards", "favicon_url", "manifest_diff"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, found.select(*names).collect()), key=repr) == sorted(map(key, want), key=repr)


def test_sentiment_reads_the_whole_text(spark):
    rows = [("plain " * 600 + word, y) for word, y in (("good", 1), ("bad", 0)) for _ in range(10)]
    docs = spark.createDataFrame(rows, "text string, sentiment int")
    found = sentiment.predict(sentiment.train(docs), docs, 0.5).collect()
    assert [r.label for r in found] == [r.sentiment for r in found]


def test_trie_holds_every_word(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select word, index_id, word_frequency from ({queries.ORACLE_SQL['trie_all_words']})").fetchall()
    found = queries.QUERIES["trie_all_words"](spark, SF).select("word", "index_id", "word_frequency").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(r.word_frequency for r in found) == queries.QUERIES["doc_stats"](spark, SF).agg(F.sum("dl")).first()[0]


@pytest.mark.parametrize("most", [0, 90])
def test_norms_without_room_for_a_broadcast(spark, tmp_path, monkeypatch, most):
    rows = [(k, "the house " * k + f"word{k} word{k % 3} the") for k in range(1, 9)] + [(9, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    rounded = lambda s: sorted(tuple(round(x, 9) for x in r) for r in s.doc_stats().collect())
    want = rounded(store.build(made, f"{tmp_path}/whole"))
    monkeypatch.setattr(store, "SENT_BYTES", most)
    assert rounded(store.build(made, f"{tmp_path}/split")) == want


def test_packed_postings_of_many_folders(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, " ".join(f"w{i % 37}" for i in range(500))), (5, "b, b é")], "doc_id long, text string")
    rows = index.unpacked(index.packed(docs, lambda term: store.bucket(term, 8))).collect()
    plain = {(r.term, r.doc_id): r for r in index.postings(docs).collect()}
    assert len(rows) == len(plain) and {r.doc_id for r in rows} == {1, 4, 5}
    lengths = {1: 4, 4: 500, 5: 3}
    for r in rows:
        same = plain[r.term, r.doc_id]
        assert (r.tf, r.positions, r.dl) == (same.tf, same.positions, lengths[r.doc_id])
    assert {(r.term, r.bucket) for r in rows} == {(r.term, r.b) for r in docs.sparkSession.createDataFrame([(t,) for t in {t for t, _ in plain}], "term string").withColumn("b", store.bucket(F.col("term"), 8)).collect()}
