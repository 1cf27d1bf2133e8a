"""Toxicity by a weighted finite-state pattern grammar.

Five weighted transducers over word classes, composed into one deterministic machine: target, negation and reported
speech mark a word while one of theirs is pending (a number of words back, or anywhere before in the clause), threat
marks a threatening word that an intention and a target precede, and insult turns insulting words and marked threats
into weights. Each reads what the one before it writes: a word class with marks. The machine runs over whole clauses
that hold an insult or a threat, so that one counts more at a target, and less under negation or in reported speech.
A document's evidence sums matched clauses by kind; a logistic model over that evidence gives the score.

Insults are a seed list, and words and word stems learnt from labelled documents by sequential covering: the pattern
that marks toxic documents best (log-likelihood ratio) is taken, the toxic documents that have it are set aside, and so
on, so that other words of insulting documents and of their copies aren't learnt. All patterns that pass the tests are
candidates and are learnt; the bound on labelled rows is what bounds a fit. Scores read nothing but the text.

Null, empty and unmatched texts have no evidence and score the model's base rate, under 0.3. Labels with a null id or
value are left out; of several for a document the largest counts. Without labels of both kinds the seed grammar scores
by fixed weights. Rows are independent, an empty table gives none; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, labelled_sample

#: Labelled rows that a fit uses at most (about), and the tests a pattern passes.
BOUND, LEAST_RATIO, LEAST_ODDS = 20_000, 14.0, 2.5
CUT = 0.3
#: Characters of a learnt stem; only longer words have it. A stem is written with a trailing *.
STEMS = (4, 5)

#: The grammar's words by class. Fixed values.
SEED = {
    "insult": "idiot idiots moron morons stupid scum loser losers vermin trash garbage pathetic worthless disgusting clown clowns filth imbecile dumb fool bastard idiota estúpido imbécil basura idiotin dummkopf abschaum crétin ordure salaud".split(),
    "threat": "kill hurt destroy beat shoot stab burn punish hang töten umbringen tuer matar".split(),
    "will": "will gonna shall going werde voy vais".split(),
    "target": "you your yours you're u they them he she him her these those ihr du sie dich euch tu vous toi ils usted tú ustedes ellos".split(),
    "negation": "not no never isn't aren't don't nobody nicht kein keine niemals ne pas jamais nunca".split(),
    "report": "said says say wrote called calls claimed reported quoted quote sagte schrieb dit écrit dijo escribió".split(),
}
CLASSES = ("other", "insult", "threat", "will", "target", "negation", "report")
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: Tropical weights: what an emission adds to a clause's path.
WEIGHTS = {"insult": 1.0, "threat": 0.8, "aimed": 0.5, "negated": -0.4, "reported": -0.3}
#: Words over which a target, a negation or an intention stays pending.
REACH = {"target": 6, "negation": 3, "will": 3}

_MARKS = ".!?;:\n\r"
_CLAUSE = re.compile(f"[{_MARKS}]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


#: What a transducer reads and writes: a word class with marks.
Symbol = tuple[str, frozenset[str]]
ALPHABET: tuple[Symbol, ...] = tuple((c, frozenset()) for c in CLASSES)


class Transducer(NamedTuple):
    """Deterministic and weighted: arcs[state][symbol read] is (next state, symbol written, weight); it starts in state 0."""

    arcs: list[dict[Symbol, tuple[int, Symbol, float]]]

    def written(self) -> set[Symbol]:
        return {out for row in self.arcs for _, out, _ in row.values()}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads what a reads and writes what b makes of a's output; weights add. Only states reachable from the start are built."""
    pairs, arcs = {(0, 0): 0}, []
    queue = [(0, 0)]
    for p, q in queue:
        row = {}
        for symbol, (p_next, middle, weight) in a.arcs[p].items():
            q_next, out, more = b.arcs[q][middle]
            after = p_next, q_next
            if after not in pairs:
                pairs[after] = len(queue)
                queue.append(after)
            row[symbol] = pairs[after], out, weight + more
        arcs.append(row)
    return Transducer(arcs)


def pending(read, kind: str, mark: str, reach: int) -> Transducer:
    """Marks words up to `reach` words after one of a kind. A state counts words since, up to reach, where it starts: it is turned so that state 0 is none pending."""
    arcs = []
    for state in range(reach + 1):  # 0: none pending; s: reach - s + 1 words since
        row = {}
        for symbol in read:
            out = (symbol[0], symbol[1] | {mark}) if state else symbol
            row[symbol] = reach if symbol[0] == kind else max(0, state - 1), out, 0.0
        arcs.append(row)
    return Transducer(arcs)


def target_transducer(read) -> Transducer:
    return pending(read, "target", "aimed", REACH["target"])


def negation_transducer(read) -> Transducer:
    return pending(read, "negation", "negated", REACH["negation"])


def report_transducer(read) -> Transducer:
    """Marks every word after one of reported speech."""
    marked = lambda x: (x[0], x[1] | {"reported"})
    return Transducer([{x: (int(x[0] == "report"), x, 0.0) for x in read}, {x: (1, marked(x), 0.0) for x in read}])


def threat_transducer(read) -> Transducer:
    """Marks a threatening word under an intention that is aimed."""
    intends = pending(read, "will", "intended", REACH["will"])
    known = sorted(intends.written(), key=repr)
    is_threat = lambda x: x[0] == "threat" and {"aimed", "intended"} <= x[1]
    chosen = Transducer([{x: (0, (x[0], x[1] - {"intended"} | ({"threat"} if is_threat(x) else set())), 0.0) for x in known}])
    return compose(intends, chosen)


def insult_transducer(read) -> Transducer:
    """Weighs insults and marked threats by their marks; of other words it writes the bare class."""
    row = {}
    for symbol in read:
        kind, marks = symbol
        if kind == "insult" or "threat" in marks:
            weight = WEIGHTS[kind] + sum(WEIGHTS[x] for x in ("aimed", "negated", "reported") if x in marks)
            row[symbol] = 0, symbol, weight
        else:
            row[symbol] = 0, (kind, frozenset()), 0.0
    return Transducer([row])


def composed() -> Transducer:
    """The grammar: insult over threat over reported speech over negation over target."""
    machine = target_transducer(ALPHABET)
    for make in (negation_transducer, report_transducer, threat_transducer, insult_transducer):
        machine = compose(machine, make(sorted(machine.written(), key=repr)))
    return machine


class Machine(NamedTuple):
    """The composition over class numbers: next states, and (kind, weight) of what is emitted."""

    step: list[list[int]]
    emit: list[list[tuple[int, float] | None]]


def kind_of(symbol: Symbol) -> int | None:
    """The number in KINDS of what the composition wrote."""
    kind, marks = symbol
    if "threat" in marks:
        return KINDS.index("threat")
    if kind != "insult":
        return None
    return KINDS.index(next((x for x in ("negated", "reported", "aimed") if x in marks), "plain"))


def compiled() -> Machine:
    step, emit = [], []
    for row in composed().arcs:
        arcs = [row[x] for x in ALPHABET]
        step.append([after for after, _, _ in arcs])
        emit.append([None if kind_of(out) is None else (kind_of(out), weight) for _, out, weight in arcs])
    return Machine(step, emit)


class Grammar:
    """The machine with a lexicon: evidence(text) is a vector by KINDS, then the best clause, then matched clauses per 100 words."""

    def __init__(self, learnt: dict[str, float]):
        self.machine = compiled()
        self.classes = {w: CLASSES.index(kind) for kind, words in SEED.items() for w in words}
        self.strength = {w: 1.0 for w in SEED["insult"]} | {w: s for w, s in learnt.items() if not w.endswith("*")}
        self.stems = {w[:-1]: s for w, s in learnt.items() if w.endswith("*")}
        self.classes |= {w: CLASSES.index("insult") for w in self.strength}
        self.starts = {w for w, k in self.classes.items() if CLASSES[k] in ("insult", "threat")}
        self.known = frozenset(self.stems)

    def triggers(self, low: str) -> set[str]:
        """Words of the text, as clause() reads them, that may start an insult or threat: set look-ups of words and of their first characters."""
        words = set(_WORD.findall(low))
        found = words & self.starts
        if self.known:
            for n in STEMS:
                if not self.known.isdisjoint({w[:n] for w in words}):
                    found |= {w for w in words if len(w) > n and w[:n] in self.known}
        return found

    def class_of(self, word: str) -> tuple[int, float]:
        kind = self.classes.get(word)
        if kind is not None:
            return kind, self.strength.get(word, 1.0)
        for n in STEMS:
            if len(word) > n and word[:n] in self.stems:
                return 1, self.stems[word[:n]]
        return 0, 1.0

    def evidence(self, text: str | None) -> list[float]:
        out = [0.0] * (len(KINDS) + 2)
        if not text:
            return out
        low, done, matched = text.lower(), 0, 0
        found = self.triggers(low)
        if not found:
            return out
        for m in _WORD.finditer(low):
            if m.start() < done or m[0] not in found:
                continue
            start = max(done, *(low.rfind(mark, done, m.start()) + 1 for mark in _MARKS))
            stop = _CLAUSE.search(low, m.end())
            done = stop.start() if stop else len(low)
            score, kinds = self.clause(low[start:done])
            if kinds:
                matched += 1
                out[len(KINDS)] = max(out[len(KINDS)], score)
                for kind, weight in kinds:
                    out[kind] += weight
        out[-1] = 100 * matched / (1 + low.count(" "))
        return out

    def clause(self, words: str) -> tuple[float, list[tuple[int, float]]]:
        """(weight of the path, its emissions as (kind, weight))."""
        state, total, said = 0, 0.0, []
        for m in _WORD.finditer(words):
            kind, strength = self.class_of(m[0])
            emitted = self.machine.emit[state][kind]
            if emitted:
                weight = emitted[1] * (strength if kind == 1 else 1.0)
                total += weight
                said.append((emitted[0], weight))
            state = self.machine.step[state][kind]
        return total, said


class Model(NamedTuple):
    learnt: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shaped(evidence) @ self.weights + self.bias, -30, 30)))


def shaped(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


#: Without labels: any plain insult in a clause of its own passes CUT.
UNTRAINED = Model({}, np.array([2.0, 3.0, 0.5, 0.8, 3.0, 2.0, 0.5]), -3.5)


def patterns(text: str) -> set[str]:
    """Words of 3 letters or more, and their stems."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def ratio(a: int, b: int, toxic: int, clean: int) -> float:
    share = (a + b) / (toxic + clean)
    return 2 * (a * math.log(max(a, 1e-9) / (toxic * share)) + b * math.log(max(b, 1e-9) / (clean * share)))


def learn_patterns(documents: list[list[str]], clean_with: dict[str, int], clean: int) -> dict[str, float]:
    """By sequential covering: documents, candidates of each toxic document; clean_with, clean documents that have a candidate. Of equals the longer pattern, then the first by name."""
    holders: dict[str, set[int]] = {}
    for k, found in enumerate(documents):
        for x in found:
            holders.setdefault(x, set()).add(k)
    toxic, out = len(documents), {}
    rated = lambda x: (ratio(len(holders[x]), clean_with[x], toxic, clean), len(x), x)
    heap = [(-r, -n, x) for r, n, x in map(rated, holders) if r > LEAST_RATIO]
    heapq.heapify(heap)
    while heap:
        r, _, best = heapq.heappop(heap)
        now, n, _ = rated(best) if holders[best] else (0.0, 0, best)
        if now < LEAST_RATIO:
            continue
        if -r > now + 1e-9:
            heapq.heappush(heap, (-now, -n, best))
            continue
        a = len(holders[best])
        if math.log((a + 0.1) / (toxic + 0.2)) - math.log((clean_with[best] + 0.1) / (clean + 0.2)) > LEAST_ODDS:
            out[best] = min(1.5, 0.5 + now / 100)
            gone = set(holders[best])
            for held in holders.values():
                held -= gone
    return out


def fit(learnt: dict[str, float], evidence: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression on shaped evidence by Newton's method; weights stay at or above 0, as no evidence makes a text cleaner."""
    if len(set(y.tolist())) < 2:
        return UNTRAINED._replace(learnt=learnt)
    x = np.hstack([shaped(np.asarray(evidence, float)), np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        lean = np.full(x.shape[1], 1e-3)
        lean[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(lean), x.T @ (p - y) / len(y) + lean * w)
        w[:-1], before = np.maximum(w[:-1] - step[:-1], 0), w.copy()
        w[-1] -= step[-1]
        if np.abs(w - before).max() < 1e-6:
            break
    return Model(learnt, w[:-1], float(w[-1]))


class _Evidence:
    """Kernel: evidence, or with weights the score, of columns (id, text, ...rest)."""

    def __init__(self, learnt: dict[str, float], model: Model | None = None):
        self.learnt, self.model = learnt, model

    def make(self):
        grammar = Grammar(self.learnt)

        def call(columns: list[pa.Array]) -> list:
            found = [grammar.evidence(t) for t in columns[1].to_pylist()]
            if self.model:
                return [columns[0], self.model.score(np.array(found).reshape(len(found), len(KINDS) + 2))]
            return [columns[2], found]

        return call


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", bound: int = BOUND) -> Model:
    """Fits on about bound labelled documents that satisfy keep. Word counts are grouped on the executors; only words that pass the tests' least counts and evidence vectors reach the driver."""
    rows = labelled_sample(docs, labels, label, keep, bound).select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y")).where(F.col("text").isNotNull())
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    learnt: dict[str, float] = {}
    if toxic and clean:
        listed = by_batch(rows.select("doc_id", "text", "y"), lambda c: [c[0], c[2], [sorted(patterns(t)) for t in c[1].to_pylist()]], "doc_id bigint, y int, found array<string>")
        counts = listed.select("y", F.explode("found").alias("pattern")).groupBy("pattern").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where((F.col("a") >= 3) & (F.col("a") / toxic > 8 * F.col("b") / clean))
        clean_with = {r.pattern: r.b for r in counts.collect()}
        own = by_batch(rows.where("y = 1").select("doc_id", "text"), lambda c: [[sorted(patterns(t) & clean_with.keys()) for t in c[1].to_pylist()]], "found array<string>")
        learnt = learn_patterns(sorted(r.found for r in own.collect()), clean_with, clean)
    found = by_batch(rows, _Evidence(learnt), "y int, x array<double>").collect()
    found.sort(key=lambda r: (r.y, r.x))
    return fit(learnt, np.array([r.x for r in found]).reshape(len(found), len(KINDS) + 2), np.array([r.y for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted: one row per document."""
    scored = by_batch(docs.select("doc_id", "text"), _Evidence(model.learnt, model), "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
