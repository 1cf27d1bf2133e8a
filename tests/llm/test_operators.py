import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontamination, html_extract, language_id, ngram_join, quality_classifier, quality_rules, toxicity

DOCS = "doc_id bigint, text string, n_words int, score string"
EDGES = [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \n\t", 1, "x"), (None, "a b c d", 1, "x"), (5, "a b c d", 1, "x"), (5, "a b c d", 1, "x"), (6, "w " * 30_000, 1, "x")]


def test_quality_rules_edges(spark):
    found = {(r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.quality_rules(spark.createDataFrame(EDGES, DOCS)).collect()}
    assert found == {(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False), (None, 4, 0, False), (5, 4, 0, False), (6, 30_000, 30_000, False)}
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_words_against_brute_force(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 30))) for _ in range(200)]
    rows = quality_rules.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        w = texts[r.doc_id].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({p for i, x in enumerate(g) if g.count(x) > 1 for p in (i, i + 1, i + 2)})


def test_chat_round_trip():
    draw = random.Random(2)
    parts = ["#", "##", "###", "\\", ":", " ", "</turn>", "\n", "a", "é"]
    for size in (1, 3, 90):
        turns = [("".join(draw.choices(parts, k=2)), "".join(draw.choices(parts, k=5))) for _ in range(size)]
        out = chat_format.marked_turns(turns)
        assert chat_format.read_back(out) == turns
        found = list(chat_format.pieces(iter(turns), chat_format.marked_turns))
        assert "".join(p[1] for p in found) == out and [chat_format.unescape(p[1][p[2] : p[3]]) for p in found] == [t for _, t in turns]
    rewriting = lambda turns: "|".join(t for _, t in turns[-2:])
    assert any(p[0] for p in chat_format.pieces(iter([("u", "a"), ("u", "b"), ("u", "c")]), rewriting))


@pytest.mark.parametrize(
    "template",
    [
        lambda turns: "|".join(t for _, t in turns[-100:]),
        lambda turns: "".join(f"{k}: {t}\n" for k, (_, t) in enumerate(turns)),
        lambda turns: f"{len(turns) // 70}" + "".join(t for _, t in turns),
    ],
)
def test_chat_pieces_of_any_template(template):
    turns = [("u", f"said {k % 7}") for k in range(130)]
    out = ""
    for k, (cut, piece, start, end, total) in enumerate(chat_format.pieces(iter(turns), template), 1):
        out = out[: len(out) - cut] + piece
        assert out == template(turns[:k]) and total == len(out)


def test_html():
    page = "<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class=ad>Buy</div><article><h1>T&amp;t</h1><p>One <b>t</b>wo<br>three<p>Four.</article><footer>&copy;</footer>"
    assert html_extract.main_text(page)[0] == "T&t One two three Four."
    assert html_extract.main_text("")[0] == ""


LONG, MORE = " ".join(["word"] * 40), " ".join(["more"] * 40)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><p>Home</div><nav>x</nav><div><h1>T</h1><p>{LONG}<p>So.</div><form>f</form><div><p>Tail</div>", f"T {LONG} So."),  # no article: runs without a surge go
        (f"<div><p>{LONG}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul><p>{MORE}</div>", f"{LONG} a b c d {MORE}"),
        (f"<div><p>{LONG}</div><aside>x</aside><div><p>{MORE}</div>", f"{LONG} {MORE}"),  # two runs
        (f"<article><p>{LONG}</p><div class=ad>Buy</div><p>So.</p></article><div class='comment-list'><p>{MORE}</div>", f"{LONG} So."),
        (f"<article><div class='share-of-market'><p>{LONG}</div></article>", LONG),
        (f"<ul><li><a>{LONG}</a></ul><div hidden>{LONG}</div><div id=cookie-notice>{LONG}</div><div><p>{MORE}</div>", MORE),
        ("<article><p>To.</article>", "To."),
    ],
)
def test_html_by_distribution(page, want):
    assert html_extract.main_text(page)[0] == want


def test_html_distribution_against_brute_force():
    draw = random.Random(8)
    for _ in range(500):
        lines = [html_extract.Line(draw.choice(["t", "t", "t", None]), 0) for _ in range(draw.randrange(0, 14))]
        lines = [x if x.text is None else x._replace(weight=draw.choice([0, 0, 5, 40, 90])) for x in lines]
        w = [x.weight for x in lines]
        sums = [sum(w[i : i + 3]) for i in range(len(w))]
        least = 80 if max(sums, default=0) >= 80 else max(sums, default=0) / 2
        held = [i for i in range(len(w)) if w[i]]
        runs = []
        for i in held:  # weights with no window of zeros between them
            runs = [*runs[:-1], [*runs[-1], i]] if runs and i - runs[-1][-1] <= 3 else [*runs, [i]]
        runs = [r for r in runs if max(sums[i] for i in range(r[0], r[-1] + 1)) >= least]
        want = {i for r in runs for i in range(r[0], r[-1] + 1)}
        for a, b in zip(runs, runs[1:], strict=False):
            if all(lines[i].text for i in range(a[-1] + 1, b[0])):
                want |= set(range(a[-1], b[0]))
        assert {i for a, b in html_extract.kept_lines(lines) for i in range(a, b)} == want


def test_html_needs_the_lengths(monkeypatch):
    page = f"<article><h1>T</h1><p>{LONG}</article>"
    lines = html_extract.lines_of(page)
    monkeypatch.setattr(html_extract, "lines_of", lambda _: [x._replace(weight=0) for x in lines])
    assert html_extract.main_text(page)[0] == ""


def in_order(words, window, room):
    """(first, last) of every place where the window's words stand in order within len(window) + room words."""
    out = set()
    for p, w in enumerate(words):
        if w == window[0]:
            ends = {p}
            for x in window[1:]:
                ends = {q for e in ends for q in range(e + 1, min(p + len(window) + room, len(words))) if words[q] == x}
            out |= {(p, e) for e in ends}
    return out


@pytest.mark.parametrize("block", [1 << 24, 20])
def test_decontamination_against_brute_force(spark, block):
    draw = random.Random(4)
    texts = [None, ""] + [" ".join(draw.choice(["A", "b", "c", "é", "d", "f"]) for _ in range(draw.randrange(0, 40))) for _ in range(80)]
    items = [(k, " ".join(draw.choice(["a", "b", "c", "é", "d"]) for _ in range(n))) for k, n in enumerate([0, 1, 3, 4, 5, 8])] + [(None, None), (None, "F d")]
    docs, bench = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for k, t in enumerate(texts):
        w, hit, own, close, near = (t or "").lower().split(), set(), set(), set(), set()
        for i, x in items:
            g = (x or "").lower().split()
            for at in range(len(g) - 3 if len(g) > 4 else 1 if g else 0):
                window = g[at : at + 4]
                name = "null" if i is None else str(i)
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        own.add(name)
                found = in_order(w, window, 2 * len(window) // 4)
                near |= {name} if found else set()
                close |= {q for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found) for q in range(a, b + 1)}
        want[k] = (len(w), hit, sorted(own), close, sorted(near))
    places = lambda spans: {q for a, b in spans for q in range(a, b)}
    found = decontamination.find(docs, bench, 4, 2, block).collect()
    assert len(found) == len(texts)
    for r in found:
        n, hit, own, close, near = want[r.doc_id]
        assert (r.n_words, places(r.spans), r["items"], r.near_items) == (n, hit, own, near)
        assert hit <= places(r.near_spans) and close <= places(r.near_spans)
        assert all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_near_windows_hold_their_words_in_order():
    queries = decontamination.compiled([("1", "a b c d e")], 5)
    for text, want in (("x a b c d e", [(1, 5)]), ("a b x c y d e", [(0, 6)]), ("a b x c y z d e", []), ("a b d c e", []), ("a x b c d a b c d e", [(5, 9)])):
        segment = decontamination.Segment(*(y if k != 1 else [t.decode() for t in y] for k, y in enumerate(decontamination.inverted([text]))), queries.vocabulary)
        found = segment.near(queries.windows, queries.lengths, 2 * queries.lengths // 5)
        assert sorted(set(zip(found[1].tolist(), found[2].tolist(), strict=True))) == want


def test_clean_drops_only_hit_rows(spark):
    rows = [(1, "one two three four", "x"), (1, "five six", "x"), (None, "zero one two three", "x"), (2, None, "x"), (3, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h1 string")
    left = decontamination.clean(docs, spark.createDataFrame([(1, "One two three")], "item_id bigint, text string"), 3)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr) and left.columns == docs.columns


@pytest.mark.parametrize(("k", "num", "limits"), [(3, 90, {}), (2, 80, {}), (3, 90, {"SMALL": 2, "BLOCK_TOKENS": 150}), (2, 80, {"SMALL": 2, "BLOCK_TOKENS": 400, "BROADCAST_ROWS": 1, "HOT": 5})])
def test_ngram_join_against_brute_force(spark, monkeypatch, k, num, limits):
    """limits: blocks, parts of components and shuffled joins come into play on few rows too."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    if "BROADCAST_ROWS" in limits:
        monkeypatch.setattr(ngram_join, "fit_to_send", lambda rows: rows)
    draw = random.Random(k)
    base = [[draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(60)] for _ in range(6)]
    rows = [(None, " ".join(base[0])), (900, None), (901, "")]
    for i in range(150):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(0, 4)):
            w[draw.randrange(len(w))] = "z" + str(draw.randrange(3))
        rows.append((i, " ".join(w[: draw.choice([60, 60, 60, 1, 2])])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
        if all(not (a and b and 100 * len(a & b) >= num * len(a | b)) or label[i] == label[j] for i, a in enumerate(sets) for j, b in enumerate(sets)):
            break
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    want = sorted(((rows[i][0], len(sets[i]), least[label[i]]) for i in range(len(rows))), key=repr)
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, k, num, 100).collect()), key=repr) == want
    kept = sorted(map(tuple, ngram_join.deduplicated(docs, k, num, 100).collect()), key=repr)
    assert kept == sorted((r for i, r in enumerate(rows) if not sets[i] or r[0] == least[label[i]]), key=repr)


def test_ngram_join_holds_no_tables_and_works_in_rounds(spark, monkeypatch):
    """Copies with changes make many pairs. By rounds the result is the same, and what is left on disk is the labels."""
    from pathlib import Path

    from lodestone.llm import common

    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.02 * (i % 4) else "x" for w in base[i % 12]) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
    tables = lambda: {x for x in Path(common.scratch(spark).removeprefix("file:")).parent.iterdir() if x.is_dir()}
    want = sorted(map(tuple, ngram_join.jaccard_components(docs, 3, 90, 100).collect()))
    monkeypatch.setattr(ngram_join, "ROUND", 6)
    before, cleanup = tables(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, 3, 90, 100).collect())) == want
    left = [t for t in tables() - before if any(x.suffix == ".parquet" for x in t.iterdir())]
    assert 0 < len(left) < 10 and not {"tokens", "marks"} & {c for t in left for c in spark.read.parquet(str(t)).columns}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == cleanup


def test_one_row_of_each_group_stays(spark):
    """Null ids, an id with two texts, and rows that are there twice."""
    copy = "one two three four five six seven"
    rows = [(None, copy, "x"), (None, copy, "x"), (5, copy, "x"), (5, copy, "x"), (7, copy + " ", "x"), (5, "quite another text that has nothing of it", "x"), (None, "alone and without an id", "x"), (None, None, "x"), (None, "only unnamed copies of this", "x"), (None, "only unnamed copies of this", "x")]
    found = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string, h string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([rows[2], rows[5], rows[6], rows[7], rows[8]], key=repr)


def test_classifiers_edges():
    assert quality_classifier.features(None) == quality_classifier.features("") == [0.0] * 14
    model = language_id.fit(*_languages())
    assert [model.predict(t)[0] for t in (None, "", "12 !", "the house and the water with that")] == ["und", "und", "und", "en"]
    grammar = toxicity.Grammar({"lowei*": 1.0})
    assert grammar.evidence("You are an idiot.")[1] > 0 and grammar.evidence("She is not an idiot.")[2] > 0 and not any(grammar.evidence("A fine day."))
    assert grammar.evidence("some loweixen here")[0] > 0


def test_quality_fits_on_every_pair_of_every_row(spark):
    import numpy as np

    rows = spark.range(21_000).selectExpr("id AS doc_id", "crc32(cast(cast(id AS string) AS binary)) AS h").selectExpr("doc_id", "concat(repeat('Some word, ', int(h % 7) + 1), repeat('|# ', int(h % 5)), doc_id, if(h % 3 = 0, '.', ' x')) AS text", "int(h % 11 + h % 7 > 6) AS quality")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "quality")
    found = quality_classifier.train(docs, labels, F.col("doc_id") >= 0)
    held = rows.collect()
    x, y = np.array([quality_classifier.features(r.text) for r in held]), np.array([r.quality for r in held])
    want = quality_classifier.fit(x, y)
    assert (found.weights == want.weights).all() and found.threshold == want.threshold and found.slope == want.slope

    x, y = x[:400], y[:400]
    found = quality_classifier.fit(x, y)
    z = (x - found.mean) / found.scale
    pairs, w = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1]), np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-pairs @ w))
        w -= np.linalg.solve((pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + 1e-3 * np.eye(len(w)), pairs.T @ (p - 1) / len(pairs) + 1e-3 * w)
    assert np.abs(found.weights - w).max() < 1e-3
    s = np.sort(found.strength(x))
    assert abs(found.threshold - s[(y == 0).sum() - 1 : (y == 0).sum() + 1].mean()) < 1e-9


@pytest.mark.parametrize("form", ["you 'idiot'", "you idiots'", "you idiot\u2022", "you idiot\uff0e", "you \U0001f600idiot\U0001f600", "you _idiot_", "you 'loweixen'", "you loweixen\u2026 \u2022loweixen\u2022"])
def test_toxicity_reads_words_beside_any_mark(form):
    assert toxicity.Grammar({"lowei*": 1.0}).evidence(form)[1] > 0


def test_toxicity_reads_a_clause_from_its_start():
    grammar = toxicity.Grammar({})
    assert grammar.evidence("Fine. They said " + "word " * 100 + "idiot")[3] > 0
    assert grammar.evidence("They said so. " + "word " * 100 + "idiot")[3] == 0


def test_rare_languages_are_learnt(spark):
    rows = [(k, "the water and the house" if k % 2 else "der und die mit auf", "en" if k % 2 else "de") for k in range(2000)] + [(k, "le la des les une et", "fr") for k in range(2000, 2004)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), 100)
    assert sorted(x for own in model.languages.values() for x in own) == ["de", "en", "fr"]


def _languages():
    import numpy as np

    texts = {"en": "the water and the house with that of in", "de": "der und die mit auf nicht ein das", "fr": "le la des les une et dans pour", "es": "el los las una y que por para"}
    rows = [(lang, " ".join(random.Random(i).sample(t.split(), 5))) for lang, t in texts.items() for i in range(15)]
    return np.array([language_id.features(t) for _, t in rows]), [lang for lang, _ in rows]


def test_tokenizers_against_libraries(spark):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    from lodestone.llm import sentencepiece_scan, token_count

    draw = random.Random(6)
    parts = ["a", "  ", "\n", "the", "ing", "é", "漢", " the", "<|endoftext|>", "!", "'s", "1", "<s>"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 90))) for _ in range(120)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, path, chunk=50).collect()} == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    path = public.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r.doc_id: (list(r.tokens), r.text_sha256) for r in sentencepiece_scan.round_trip(docs, path, chunk=40).collect()}
    assert found == {k: (pieces.encode(t) if t else [], hashlib.sha256((t or "").encode()).hexdigest()) for k, t in enumerate(texts)}
    assert re.fullmatch("[0-9a-f]{64}", found[0][1])
