"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, html_extract, language_id, ngram_join, quality_classifier, quality_rules, sentencepiece_scan, token_count, toxicity
from .common import fold, table

#: Place of the tokenizer files; a parameter of the operators.
TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"said": said})
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(more)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).select("*", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality_classifier.classify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold("doc_id", 4) != 2)
    return language_id.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_toxicity, op4_decontamination, op5_html_extract, op6_sentencepiece, op7_token_count, op8_quality_classifier, op9_language_id, op10_ngram_join)}

def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STOP = sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws})
_RULES = " AND ".join(f"coalesce({r.numerator}::DOUBLE / nullif({r.denominator}, 0) BETWEEN {r.low} AND {r.high}, true)" for r in quality_rules.RULES)
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESC = r"regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, len(list_filter(w, lambda x: lower(x) IN ({_sql_list(_STOP)}))) AS n_stop_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM b""",
    "op2_chat_format": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256, coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(role) + length({_ESC}) + 14)::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites FROM c GROUP BY 1""",
    # A chain follows the words of a window through a document, in order and in at most its length and room more.
    "op4_decontamination": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents),
tok AS (SELECT r, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS t FROM benchmark),
x AS (SELECT item, unnest(CASE WHEN len(t) <= 10 THEN [t] ELSE list_transform(range(len(t) - 9), lambda k: t[k + 1:k + 10]) END) AS words FROM i WHERE len(t) > 0),
win AS (SELECT row_number() OVER () AS id, words, len(words) AS n, 2 * len(words) // 10 AS room FROM (SELECT DISTINCT words FROM x)),
held AS (SELECT DISTINCT id, item FROM x JOIN win USING (words)),
chain AS (SELECT id, r, p AS first, p AS last, 1 AS k FROM win JOIN tok ON w = words[1]
 UNION ALL SELECT c.id, c.r, c.first, tok.p, c.k + 1 FROM (SELECT c.*, win.words[c.k + 1] AS wanted, win.room, unnest(range(c.last + 1, c.first + c.k + win.room + 1)) AS q FROM chain c JOIN win USING (id) WHERE c.k < win.n) c JOIN tok ON tok.r = c.r AND tok.w = c.wanted AND tok.p = c.q),
ends AS (SELECT DISTINCT id, r, first, last, n FROM chain JOIN win USING (id) WHERE k = n),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(first, last + 1)) AS q FROM ends WHERE last - first + 1 = n) GROUP BY 1),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM ends JOIN held USING (id) WHERE last - first + 1 = n) GROUP BY 1),
near AS (SELECT r, count(DISTINCT item) AS n_near_items FROM ends JOIN held USING (id) GROUP BY 1)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r) LEFT JOIN near USING (r)""",
}
