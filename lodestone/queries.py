"""One query per operator over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import expand, index, present, rank, sentiment, store
from .plans import boolean
from .plans.storage import fit_to_send, scratch
from .sources import corpus, files
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CLS = T.delimiters().replace("'", "''")
TD = rf"""WITH td AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{CLS}'), lambda x: lower(x)), lambda x: x <> '' AND x <> '\') AS t FROM documents),
tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM td),
tf AS (SELECT term, doc_id, count(*) AS tf, list_sort(list(pos)) AS positions FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1),
dl AS (SELECT doc_id, len(t) AS dl FROM td),
c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS lbar FROM dl)
"""
RANKED = "the and of work community"
PHRASE = "of the"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("").alias("headline"), "text", "source", "lang")


_stores: dict[tuple[str, str], store.Store] = {}


def stored(spark: SparkSession, sf_dir: str) -> store.Store:
    """The stored index of the documents, built at the first query of an application that needs it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        _stores[key] = store.build(docs(spark, sf_dir).drop("source", "lang"))
    return _stores[key]


def listed(column: str):
    return F.concat_ws(",", F.col(column).cast("array<string>"))


@query(TD + "SELECT doc_id, array_to_string(t, ' ') AS tokens FROM td")
def tokenise(spark, sf):
    return index.tokenised(docs(spark, sf)).select("doc_id", F.concat_ws(" ", "t").alias("tokens"))


#: Stop words of the query; the operator takes any list, such as english_stop_words().
STOP = "the and of to a in is that for it as was with be by on not he his but at are this".split()


@query(TD + "SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + ")), ' ') AS tokens FROM td")
def tokenise_stopped(spark, sf):
    return index.tokenised(docs(spark, sf), stop_words=STOP).select("doc_id", F.concat_ws(" ", "t").alias("tokens"))


@query()
def tokenise_stemmed(spark, sf):
    return index.tokenised(docs(spark, sf), stem=True).select("doc_id", F.concat_ws(" ", "t").alias("tokens"))


@query(TD + "SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM tf")
def postings(spark, sf):
    return index.postings(docs(spark, sf)).select("term", "doc_id", "tf", listed("positions").alias("positions"))


@query(TD + "SELECT term, df, cf FROM df")
def lexicon_df(spark, sf):
    return stored(spark, sf).lexicon()


@query(TD + "SELECT (SELECT count(*) FROM tf) AS postings, (SELECT count(*) FROM df) AS terms, n, round(lbar, 6) AS lbar FROM c")
def index_build(spark, sf):
    """Builds and stores a whole index; the row says what it holds."""
    made = store.build(docs(spark, sf).drop("source", "lang"))
    counted = made.postings().agg(F.count("*").alias("postings")).crossJoin(made.lexicon().agg(F.count("*").alias("terms")))
    return counted.crossJoin(made.corpus_stats().select("n", F.round("lbar", 6).alias("lbar")))


@query(TD + "SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM tf")
def stored_postings(spark, sf):
    return stored(spark, sf).postings().select("term", "doc_id", "tf", listed("positions").alias("positions"))


@query(TD + ", w AS (SELECT doc_id, tf, df, n, dl, lbar, max(tf) OVER (PARTITION BY doc_id) AS m FROM tf JOIN df USING (term) JOIN dl USING (doc_id), c), s AS (SELECT doc_id, max(m) AS max_tf, sqrt(sum(pow((1 + log10(tf)) * log10(n / df), 2))) AS lt, sqrt(sum(pow((0.5 + 0.5 * tf / m) * CASE WHEN df >= n THEN 0 ELSE greatest(0, log10((n - df) / df)) END, 2))) AS ap, sqrt(sum(tf * tf)) AS nn, sqrt(sum(pow(tf / (1.5 * (dl / lbar) + tf + 0.5) * log10((n - df + 0.5) / (df + 0.5)), 2))) AS bm25 FROM w GROUP BY 1) SELECT doc_id, dl, coalesce(max_tf, 0) AS max_tf, round(coalesce(lt, 0), 4) AS lt, round(coalesce(ap, 0), 4) AS ap, round(coalesce(nn, 0), 4) AS nn, round(coalesce(bm25, 0), 4) AS bm25 FROM dl LEFT JOIN s USING (doc_id)")
def stored_norms(spark, sf):
    norms = {"lt": "norm_lt", "ap": "norm_ap", "nn": "norm_nn", "bm25": "norm_bm25"}
    return stored(spark, sf).doc_stats().select("doc_id", "dl", "max_tf", *(F.round(c, 4).alias(k) for k, c in norms.items()))


@query(TD + "SELECT doc_id, dl FROM dl")
def doc_stats(spark, sf):
    return index.doc_stats(docs(spark, sf))


@query(TD + "SELECT n, round(lbar, 6) AS lbar FROM c")
def corpus_stats(spark, sf):
    return index.corpus_stats(docs(spark, sf)).select("n", F.round("lbar", 6).alias("lbar"))


@query(rf"""WITH h AS (SELECT p_partkey AS doc_id, list_filter(list_transform(string_split_regex(p_name, '{CLS}'), lambda x: lower(x)), lambda x: x <> '' AND x <> '\') AS t FROM part)
SELECT array_to_string(t, ' ') AS headline, max(doc_id) AS doc_id, array_to_string(range(max(len(t))), ',') AS span FROM h WHERE len(t) > 0 GROUP BY 1""")
def headline_index(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("headline"))
    return index.headline_index(parts).select("headline", "doc_id", listed("span").alias("span"))


def has(*words: str) -> str:
    return " AND ".join(f"doc_id IN (SELECT doc_id FROM tf WHERE term = '{w}')" for w in words)


def boolean_query(name: str, text: str, where: str, positions: str | None = None):
    """Registers a boolean query; positions: SQL of the position list of a document d."""

    def run(spark, sf):
        found = boolean.stored(text, stored(spark, sf))
        return found.select("doc_id", listed("positions").alias("positions")) if positions else found.select("doc_id")

    run.__name__ = name
    query(TD + f"SELECT doc_id{', ' + positions + ' AS positions' if positions else ''} FROM td d WHERE {where}")(run)


def at(word: str) -> str:
    return f"coalesce((SELECT positions FROM tf WHERE term = '{word}' AND tf.doc_id = d.doc_id), [])"


boolean_query("bool_term", "with", has("with"), f"array_to_string({at('with')}, ',')")
boolean_query("bool_all_words", "with by", has("with", "by"), f"array_to_string(list_sort(list_concat({at('with')}, {at('by')})), ',')")
boolean_query("bool_and", "with AND by", has("with", "by"), f"array_to_string(list_concat({at('with')}, {at('by')}), ',')")
boolean_query("bool_or", "von OR dans", f"({has('von')}) OR ({has('dans')})", f"array_to_string(list_concat({at('von')}, {at('dans')}), ',')")
boolean_query("bool_not", "NOT the NOT de", f"NOT ({has('the')}) AND NOT ({has('de')})")
boolean_query("bool_and_not", "the AND NOT with AND NOT by", f"{has('the')} AND NOT ({has('with')}) AND NOT ({has('by')})")
boolean_query("bool_or_not", "von OR NOT the OR dans", f"({has('von')}) OR NOT ({has('the')}) OR ({has('dans')})")
boolean_query("bool_precedence", "with OR by AND from", f"({has('with')} OR {has('by')}) AND {has('from')}")
boolean_query("bool_not_padded", "  NOT the NOT de ", f"NOT ({has('the')}) AND NOT ({has('de')})")
boolean_query("bool_empty", "  ", "false", "''")
boolean_query("phrase", f'"{PHRASE}"', "EXISTS (SELECT 1 FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.doc_id = d.doc_id AND a.term = 'of' AND b.term = 'the')")
boolean_query("phrase_positions", '"the the"', "EXISTS (SELECT 1 FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.doc_id = d.doc_id AND a.term = 'the' AND b.term = 'the')", "(SELECT string_agg(a.pos::VARCHAR, ',' ORDER BY a.pos) FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.doc_id = d.doc_id AND a.term = 'the' AND b.term = 'the')")
boolean_query("proximity_2", "#2(the, a)", "EXISTS (SELECT 1 FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND abs(b.pos - a.pos) <= 2 WHERE a.doc_id = d.doc_id AND a.term = 'the' AND b.term = 'a')")
boolean_query("proximity_k", "#12(with, by, from)", "EXISTS (SELECT 1 FROM tok a JOIN tok b ON b.doc_id = a.doc_id JOIN tok e ON e.doc_id = a.doc_id WHERE a.doc_id = d.doc_id AND a.term = 'with' AND b.term = 'by' AND e.term = 'from' AND greatest(a.pos, b.pos, e.pos) - least(a.pos, b.pos, e.pos) <= 12)")


def pair(spark, sf):
    found = stored(spark, sf).postings(["the", "of"]).groupBy("doc_id").agg(*(F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(n) for w, n in (("the", "a"), ("of", "b"))))
    return found


PAIR = TD + ", p AS (SELECT doc_id, coalesce(flatten(list(CASE WHEN term = 'the' THEN positions END) FILTER (term = 'the')), []) AS a, coalesce(flatten(list(CASE WHEN term = 'of' THEN positions END) FILTER (term = 'of')), []) AS b FROM tf WHERE term IN ('the', 'of') GROUP BY 1) "


@query(PAIR + "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS positions FROM p")
def posting_union(spark, sf):
    return pair(spark, sf).select("doc_id", index.union(F.col("a"), F.col("b")).alias("p")).select("doc_id", listed("p").alias("positions"))


@query(PAIR + "SELECT doc_id, array_to_string(list_sort(list_intersect(a, list_transform(b, lambda x: x - 1))), ',') AS positions FROM p")
def posting_intersect(spark, sf):
    return pair(spark, sf).select("doc_id", index.intersect(F.col("a"), index.shift(F.col("b"), 1)).alias("p")).select("doc_id", listed("p").alias("positions"))


@query(PAIR + "SELECT doc_id, array_to_string(list_transform(a, lambda x: x - 3), ' --> ') AS positions FROM p")
def posting_shift(spark, sf):
    return pair(spark, sf).select("doc_id", index.shown(index.shift(F.col("a"), 3)).alias("positions"))


Q = ", q AS (SELECT * FROM (VALUES ('the', 1), ('and', 1), ('of', 1), ('work', 1), ('community', 1)) AS v(term, qtf)) "
TOP = " SELECT doc_id, round(score, 4) AS score FROM s ORDER BY round(score, 4) DESC, doc_id LIMIT "


@query(TD + Q + ", s AS (SELECT doc_id, sum(qtf * (1 + log10(tf)) * log10(n / df)) AS score FROM tf JOIN df USING (term) JOIN q USING (term), c GROUP BY 1)" + TOP + "150")
def rank_tfidf(spark, sf):
    return rank.top(rank.tfidf(stored(spark, sf), RANKED), 150)


@query(TD + Q + ", s AS (SELECT doc_id, sum(tf / (1.5 * (dl / lbar) + tf + 0.5) * log10((n - df + 0.5) / (df + 0.5))) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (doc_id), c GROUP BY 1)" + TOP + "150")
def rank_bm25(spark, sf):
    return rank.top(rank.bm25(stored(spark, sf), RANKED), 150)


COSINE = ", z AS (SELECT w.doc_id, sum(w * coalesce(qw, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(qw * qw)) FROM qv)) AS score FROM w LEFT JOIN qv USING (term) GROUP BY 1), s AS (SELECT doc_id, coalesce(score, 0) AS score FROM dl LEFT JOIN z USING (doc_id))"
TFIDF_W = ", w AS (SELECT doc_id, term, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), c), qv AS (SELECT term, (1 + log10(qtf)) * log10(n / df) AS qw FROM q JOIN df USING (term), c)"


@query(TD + Q + TFIDF_W + COSINE + TOP + "10")
def vsm_cosine_tfidf(spark, sf):
    return rank.top(rank.vsm(stored(spark, sf), RANKED), 10)


@query(TD + Q + ", w AS (SELECT doc_id, term, tf / (1.5 * (dl / lbar) + tf + 0.5) * log10((n - df + 0.5) / (df + 0.5)) AS w FROM tf JOIN df USING (term) JOIN dl USING (doc_id), c), qv AS (SELECT term, qtf / (1.5 + qtf + 0.5) * log10((n - df + 0.5) / (df + 0.5)) AS qw FROM q JOIN df USING (term), c)" + COSINE + TOP + "10")
def vsm_cosine_bm25(spark, sf):
    return rank.top(rank.vsm(stored(spark, sf), RANKED, mode="bm25"), 10)


@query(TD + "SELECT term, doc_id, tf::DOUBLE AS n, round(1 + log10(tf), 4) AS l, round(0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id), 4) AS a FROM tf")
def tf_modes(spark, sf):
    return stored(spark, sf).postings().select("term", "doc_id", *(F.round(rank.tf_weight(m, F.col("tf"), F.col("max_tf")), 4).alias(m) for m in "nla"))


@query(TD + "SELECT term, round(log10(n / df), 4) AS t, round(CASE WHEN df >= n THEN 0 ELSE greatest(0, log10((n - df) / df)) END, 4) AS p, round(log10((n - df + 0.5) / (df + 0.5)), 4) AS bm25 FROM df, c")
def idf_modes(spark, sf):
    full = stored(spark, sf).lexicon().crossJoin(F.broadcast(stored(spark, sf).corpus_stats()))
    return full.select("term", *(F.round(rank.idf_weight(m, F.col("df"), F.col("n")), 4).alias(m) for m in ("t", "p", "bm25")))


@query(TD + Q + TFIDF_W + COSINE + ", f AS (SELECT doc_id FROM s ORDER BY round(score, 4) DESC, doc_id LIMIT 5), e AS (SELECT term, qw AS weight FROM qv UNION ALL SELECT term, w / 5 FROM w JOIN f USING (doc_id)) SELECT term, round(sum(weight), 4) AS weight FROM e GROUP BY 1")
def prf_terms(spark, sf):
    return rank.feedback(stored(spark, sf), docs(spark, sf), RANKED).select("term", F.round("weight", 4).alias("weight"))


@query(TD + ", w AS (SELECT * FROM (VALUES ('teh'), ('wiht'), ('annd'), ('qqqqqqqq')) AS v(word)), r AS (SELECT word, term, levenshtein(word, term) AS d, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS r FROM w, df WHERE levenshtein(word, term) <= 2) SELECT word, coalesce(term, word) AS correction, coalesce(d, -1)::INT AS distance FROM w LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (word)")
def spell_correct(spark, sf):
    words = spark.createDataFrame([("teh",), ("wiht",), ("annd",), ("qqqqqqqq",)], "word string")
    return expand.spell_correct(words, stored(spark, sf).lexicon())


MISSPELT = "teh house AND wiht qqqqqqqq"


@query(TD + ", w AS (SELECT * FROM (VALUES ('teh'), ('house'), ('wiht'), ('qqqqqqqq')) AS v(word)), r AS (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS r FROM w, df WHERE levenshtein(word, term) <= 2), b AS (SELECT word, coalesce(term, word) AS new FROM w LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (word)), g AS (SELECT max(new) FILTER (word = 'teh') AS t, max(new) FILTER (word = 'house') AS h, max(new) FILTER (word = 'wiht') AS w, max(new) FILTER (word = 'qqqqqqqq') AS q FROM b) SELECT t || ' ' || h || ' AND ' || w || ' ' || q AS corrected, (SELECT count(*) FROM b WHERE word <> new) AS n_corrections, (SELECT count(*) FROM b WHERE word <> new) > 0 AS changed FROM g")
def did_you_mean(spark, sf):
    found = expand.check_and_correct(MISSPELT, stored(spark, sf).lexicon())
    return spark.createDataFrame([(found.text, len(found.corrections), found.changed)], "corrected string, n_corrections bigint, changed boolean")


@query(TD + "SELECT term, df, cf FROM df WHERE starts_with(term, 'th') ORDER BY df DESC, term LIMIT 10")
def prefix_suggest(spark, sf):
    return expand.prefix_suggest(stored(spark, sf).lexicon(), "th")


@query(TD + "SELECT term AS word, max_by(doc_id, doc_id * 1000000 + pos) AS index_id, count(*) AS word_frequency FROM tok WHERE starts_with(term, 'ing') GROUP BY 1")
def trie_words(spark, sf):
    return index.with_prefix(trie(spark, sf), "ing")


@query(TD + "SELECT term AS word, max_by(doc_id, doc_id * 1000000 + pos) AS index_id, count(*) AS word_frequency FROM tok GROUP BY 1")
def trie_all_words(spark, sf):
    """The trie's whole vocabulary; trie_words looks up one prefix."""
    rows = index.tokenised(docs(spark, sf)).select("doc_id", F.posexplode("t").alias("pos", "word"))
    return index.trie_words(rows.select("word", F.col("doc_id").alias("index_id"), (F.col("doc_id") * 1000000 + F.col("pos")).alias("seq")))


def trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie's words, by the stored index: a word's inserts are its tokens, in the order of documents and places."""
    last = F.max(F.struct("doc_id", F.element_at("positions", -1)))
    return stored(spark, sf).postings().groupBy(F.col("term").alias("word")).agg(last["doc_id"].alias("index_id"), F.sum("tf").alias("word_frequency"))


@query(TD + "SELECT term AS word, max(doc_id) AS index_id, count(*) AS word_frequency FROM tok WHERE term = 'the' GROUP BY 1")
def trie_search(spark, sf):
    return index.trie_search(trie(spark, sf), "the")


@query(TD + "SELECT count(*) AS size FROM tok")
def trie_len(spark, sf):
    return index.trie_len(stored(spark, sf).lexicon().select(F.col("cf").alias("word_frequency")))


@query(TD + "SELECT term AS word, max(doc_id) AS index_id, count(*) AS word_frequency, row_number() OVER (ORDER BY encode(term)) AS place FROM tok GROUP BY 1")
def trie_traverse(spark, sf):
    return files.numbered(index.trie_traverse(trie(spark, sf)), ["word"], "place")


@query(TD + ", w AS (SELECT doc_id, term, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), c) SELECT doc_id, term, round(w, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, encode(term)) AS r FROM w) WHERE r <= 5")
def vector_top_terms(spark, sf):
    return rank.top_terms(rank.vectors(stored(spark, sf)), 5, "doc_id").select("doc_id", "term", F.round("weight", 4).alias("weight"))


FEEDBACK = ", f AS (SELECT doc_id FROM s ORDER BY round(score, 4) DESC, doc_id LIMIT 5), e AS (SELECT term, qw AS weight FROM qv UNION ALL SELECT term, w / 5 FROM w JOIN f USING (doc_id)), x AS (SELECT term, sum(weight) AS qw FROM e GROUP BY 1)"


@query(TD + Q + TFIDF_W + COSINE + FEEDBACK + ", y AS (SELECT doc_id, coalesce(sum(w * qw), 0) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(qw * qw)) FROM x)) AS score FROM w LEFT JOIN x USING (term) GROUP BY 1) SELECT doc_id, round(score, 4) AS score FROM y ORDER BY round(score, 4) DESC, doc_id LIMIT 10")
def expand_prf(spark, sf):
    """Documents of the query expanded by feedback."""
    s = stored(spark, sf)
    return rank.top(rank.cosine(s, expand.expand(s, docs(spark, sf), RANKED)), 10)


@query("SELECT 'the and of work community also neighbours work_done' AS expanded")
def expand_syn(spark, sf):
    table = spark.createDataFrame([("and", "also"), ("work", "work_done"), ("community", "neighbours"), ("unused", "x")], "word string, synonym string")
    return spark.createDataFrame([(expand.expand(stored(spark, sf), docs(spark, sf), RANKED, "syn", table),)], "expanded string")


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS plain FROM documents")
def unicode_normalise(spark, sf):
    return docs(spark, sf).select("doc_id", T.unicode_normalise("text").alias("plain"))


SNIP = "CASE WHEN p IS NULL THEN array_to_string(t[1:15], ' ') ELSE '...' || array_to_string(list_concat(list_concat(t[greatest(p - 15, 0) + 1:p], ['<b>' || t[p + 1] || '</b>']), t[p + 2:p + 15]), ' ') || '...' END"


@query(TD + f", x AS (SELECT doc_id, t, (SELECT min(pos) FROM tok WHERE tok.doc_id = td.doc_id AND term = 'with' AND pos >= 5) AS p FROM td WHERE {has('with')}) SELECT doc_id, {SNIP} AS snippet FROM x")
def snippet(spark, sf):
    d = docs(spark, sf)
    hits = d.join(boolean.stored("with", stored(spark, sf)), "doc_id").select("doc_id", "positions", T.tokens(F.col("text")).alias("t"))
    return hits.select("doc_id", present.snippet(F.col("t"), present.bold_position(F.col("positions"), F.lit("title"))).alias("snippet"))


@query(TD + f", x AS (SELECT doc_id, source, lang, t, (SELECT min(pos) FROM tok WHERE tok.doc_id = td.doc_id AND term = 'with') AS p FROM td WHERE {has('with')} ORDER BY doc_id LIMIT 5) SELECT doc_id, '' AS title, 'https://news.example/' || doc_id AS url, 'https://www.google.com/s2/favicons?sz=64&domain_url=' || replace(lower(source), ' ', '') || '.com' AS image, '2024-02-19' AS date, source AS publisher, 0.0::DOUBLE AS sentiment, {SNIP} AS content FROM x")
def result_cards(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.col("headline").alias("title"), "text", F.concat(F.lit("https://news.example/"), F.col("doc_id")).alias("url"), F.lit("2024-02-19T00:00").alias("date"), F.col("source").alias("publisher"))
    return present.cards(boolean.stored("with", stored(spark, sf)).withColumn("rank", F.lit(0)), rows)


@query("SELECT publisher, 'https://www.google.com/s2/favicons?sz=64&domain_url=' || CASE lower(publisher) WHEN 'guardian' THEN 'theguardian' WHEN 'journal' THEN 'thejournal' ELSE replace(lower(publisher), ' ', '') END || '.com' AS icon FROM (SELECT DISTINCT c_mktsegment AS publisher FROM customer UNION ALL SELECT * FROM (VALUES ('Guardian'), ('journal'), ('Fox News')))")
def favicon_url(spark, sf):
    named = spark.createDataFrame([("Guardian",), ("journal",), ("Fox News",)], "publisher string")
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("publisher")).distinct().union(named).withColumn("icon", present.favicon(F.col("publisher")))


@query()
def html_extract(spark, sf):
    return files.html_documents(spark.read.parquet(f"{sf}/pages.parquet"))


@query("SELECT url AS path, sha256(html) AS sha256 FROM pages")
def checksum_manifest(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))


#: What tells pages apart: an url may have several.
PAGE = ("page_id", "path")


@query("SELECT url AS path, sha256(html) AS sha256 FROM pages WHERE page_id % 3 = 0 OR page_id % 3 = 1")
def manifest_diff(spark, sf):
    """Against a manifest in which a third of the pages is missing, a third has another checksum, and a gone page is listed. Pages may share an url, so their ids tell them apart too."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    old = pages.where("NOT page_id % 3 <=> 0").select(*PAGE, F.when(F.col("page_id") % 3 == 1, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.range(1).select(F.lit(-1).cast("bigint").alias("page_id"), F.lit("gone.html").alias("path"), F.lit("x").alias("sha256"))
    manifest = files.pruned(old.union(gone), pages, PAGE)
    return files.changed(pages, manifest, PAGE).select("path", "sha256")


@query("SELECT url AS path, sha256(html) AS sha256 FROM pages WHERE page_id % 3 = 0")
def manifest_queue(spark, sf):
    """Keeps a manifest of two thirds of the pages; the queue against it holds the rest, and is empty once cleared."""
    path = scratch(spark)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    files.save_manifest(pages.where("NOT page_id % 3 <=> 0"), path, PAGE)
    queue = files.change_queue(pages, path, clear=True, key=PAGE)
    return queue.unionByName(files.change_queue(pages, path, key=PAGE)).select("path", "sha256")


NEWS_SQL = "SELECT o_orderkey AS k, o_orderdate::DATE::VARCHAR AS date, 'Order <' || o_orderkey || '> & more' AS title, 'First \"line\"' || chr(10) || 'of ' || o_orderpriority AS article, o_orderstatus AS outlet FROM orders"


def news(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    title = F.concat(F.lit("Order <"), F.col("o_orderkey"), F.lit("> & more"))
    body = F.concat(F.lit('First "line"\nof '), F.col("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").cast("string").alias("date"), title.alias("title"), body.alias("article"), F.col("o_orderstatus").alias("outlet"))


@query(f"WITH n AS ({NEWS_SQL}) SELECT row_number() OVER (ORDER BY date, title) AS docno, date, title AS news_title, replace(article, chr(10), ' ') AS text FROM n")
def xml_round_trip(spark, sf):
    path = scratch(spark)
    files.write_xml(news(spark, sf), path)
    back = files.read_xml(spark, path, "DOCNO bigint, DATE string, HEADLINE string, TEXT string")
    return files.xml_to_rows(back, "DOCNO", "DATE").select(F.col("DOCNO").alias("docno"), F.col("DATE").alias("date"), "news_title", "text")


@query(f"WITH n AS ({NEWS_SQL}) SELECT k, date, title, article, outlet FROM n")
def csv_round_trip(spark, sf):
    path = scratch(spark)
    files.write_csv(news(spark, sf), path)
    return files.read_csv(spark, path, "k bigint, date string, title string, article string, outlet string")


@query(f"WITH n AS ({NEWS_SQL}) SELECT title AS headline, replace(article, chr(10), ' ') AS text, lower(outlet) AS outlet FROM n")
def html_round_trip(spark, sf):
    """Renders a page per row, writes them by outlet, reads the folder and parses the pages."""
    path = scratch(spark)
    empty = {c: F.lit("") for c in ("lead_paragraph", "authors", "domain", "url", "political_leaning")}
    pages = files.rendered(news(spark, sf).withColumnRenamed("k", "doc_id").withColumns(empty))
    pages.write.parquet(path)
    return files.html_documents(spark.read.parquet(path), "outlet_key").select("headline", "text", F.col("doc_id").alias("outlet"))


@query("SELECT text AS title, text AS article, source AS outlet, lang AS domain, 'a,c' AS authors, '2024-02-19' AS date, 'u' || doc_id AS url FROM documents")
def feed_parse(spark, sf):
    """Documents as responses of a feed in JSON, parsed back."""
    tags = F.array(*(F.struct(F.lit(kind).alias("type"), F.lit(who).alias("webTitle")) for kind, who in (("contributor", "a"), ("keyword", "b"), ("contributor", "c"))))
    fields = F.struct(F.col("text").alias("headline"), F.col("text").alias("bodyText"), F.lit("2024-02-19").alias("firstPublicationDate"))
    result = F.struct(F.concat(F.lit("u"), F.col("doc_id")).alias("webUrl"), F.col("lang").alias("sectionName"), fields.alias("fields"), tags.alias("tags"))
    responses = docs(spark, sf).select("source", F.to_json(F.struct(F.struct(F.array(result).alias("results")).alias("response"))).alias("value"))
    found = ingest.feed_articles(responses.select("value"))
    known = docs(spark, sf).select(F.concat(F.lit("u"), F.col("doc_id")).alias("url"), "source")
    return found.join(known, "url").select("title", "article", F.col("source").alias("outlet"), "domain", "authors", "date", "url")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey::VARCHAR AS date_publish, c_mktsegment AS outlet, nullif(c_name, 'Customer#000000001') AS headline FROM customer WHERE c_custkey <> 1 AND c_name IS NOT NULL")
def news_prepared(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    named = {"date_publish": F.col("c_custkey").cast("string"), "outlet": F.col("c_mktsegment"), "headline": F.when(F.col("c_custkey") != 1, F.col("c_name")), **{c: F.lit("") for c in ("lead", "body", "authors", "domain", "url", "political_leaning")}}
    return corpus.prepared(rows.select(*(c.alias(k) for k, c in named.items()), F.lit(1).alias("more"))).select("date_publish", "outlet", "headline")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def dedup_insert(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return corpus.new_documents(d.union(d), d.where("doc_id % 2 = 0"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 10")
def outlet_sample(spark, sf):
    return corpus.group_sample(docs(spark, sf).select("doc_id", "source"), "source", 10, F.md5(F.col("doc_id").cast("string").cast("binary")))


@query("SELECT o_orderkey, o_orderstatus AS publication, o_orderdate AS date FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= '1996-01-01' AND o_orderpriority IS NOT NULL ORDER BY o_orderdate")
def news_filter(spark, sf):
    news = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("publication"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("article"), F.col("o_orderdate").alias("date"))
    return corpus.news_filter(news, ["O", "F"], "1996-01-01").drop("title", "article")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf):
    return corpus.point_lookup(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars"), 42)


MON = "CASE month(d) " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(T.MONTHS, 1)) + " END"


@query(f"WITH h AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders) SELECT k, 'FT' AS source, strftime(d, '%d') || '/' || {MON} || '/' || strftime(d, '%y') AS date, 'Title ' || k AS title, d AS day FROM h")
def headline_date_parse(spark, sf):
    names = F.array(*map(F.lit, T.MONTHS))
    d = F.col("o_orderdate")
    headline = F.concat(F.lit("FT  "), F.date_format(d, "dd"), F.lit(" "), F.get(names, F.month(d) - 1), F.lit(" "), F.date_format(d, "yy"), F.lit(" / Title "), F.col("o_orderkey"))
    source, date, title = T.headline_parts(F.col("h"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), headline.alias("h")).select("k", source.alias("source"), date.alias("date"), title.alias("title"), T.short_date(date).alias("day"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def live_ingest_counts(spark, sf):
    return ingest.counts_per_window(spark.read.parquet(f"{sf}/events.parquet"))


@query()
def sentiment_threshold(spark, sf):
    """Learns from labels whose crc32(doc_id) mod 5 is not 0 and scores every document; the labels of the rest are for evaluate()."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    labelled = rows.join(fit_to_send(labels.select("doc_id", F.col("quality").alias("sentiment"))), "doc_id")
    return sentiment.predict(sentiment.train(labelled), rows).select("doc_id", "p", "label")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '([a-zA-Z]+):', 1), ',') AS words FROM documents")
def named_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat_ws(",", T.named_words(F.col("text"))).alias("words"))


def entities_sql() -> str:
    """Accented letters are word characters there as here, once they are underscores."""
    counted = " UNION ALL ".join(f"SELECT '{label}' AS label, sum(len(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g'), '{p}')))::BIGINT AS n FROM documents" for label, p in T.ENTITY_PATTERNS)
    return f"SELECT label, n FROM ({counted}) WHERE n > 0"


@query(entities_sql())
def entities(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(T.entities(F.col("text"))).alias("e")).groupBy("e.label").agg(F.count("*").alias("n"))
