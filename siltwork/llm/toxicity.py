"""Toxicity by a weighted finite-state pattern grammar.

Words fall into classes: insult, threat, target, negation, report. Insult stems are
learned from labels as word beginnings (or whole words) that toxic texts have and clean
ones do not; the other classes are closed ones, as function words and verbs of saying
are in any language, and stand here as short lists. Four transducers over class symbols
(naming of hits, negation scope, reported speech, target) are composed into one machine.
It runs over each clause that holds an insult or threat, rewrites the hits to labels
(plain, negated, reported, aimed, threatening and their combinations) and adds the
weights of their arcs. The arcs' weights are fitted to labels around a prior, and a
text's score is a logistic function of its clauses' weights and of its hits by label,
fitted on the same labelled sample.

A null or empty text, or one without a hit, scores as such texts do. Texts of any length
are read whole, in time linear in their length. Repeated rows stay rows of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small_batches, tasks_for, written
from .labelled import free_name, remainder, sample

# Word lists of the grammar's closed classes, in the languages of the data.
TARGETS = "you your yours he she they them him her his their this that these those it people everyone du dich dir ihr euch er sie tu toi te vous il elle ils elles tú te ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never none neither nor isn't aren't don't without nicht kein keine nie niemals ne pas jamais sans nunca jamás sin tampoco".split()
REPORTS = "said says say wrote writes claimed claims called quoted reported according alleged sagte sagt schrieb behauptete laut dit disait écrit selon déclaré dijo dice escribió según afirmó".split()
THREATS = "kill hurt destroy attack beat shoot burn töten umbringen verletzen tuer frapper détruire matar herir golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLAUSE_END = re.compile(r"[.!?;:\n]")
TOKEN = re.compile(r"(?<!\w)[^\W\d_][\w']*")
STEM_FROM, STEM_TO = 4, 12


@dataclass
class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, symbol out, weight)``; weights of a path add up."""

    states: int
    step: dict[tuple[int, int], tuple[int, int, float]]


def compose(a: Transducer, b: Transducer, symbols: range) -> Transducer:
    """What a writes, b reads. States that the start reaches, numbered as found."""
    number, todo, step = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        p, q = todo.pop()
        for s in symbols:
            p2, mid, wa = a.step[p, s]
            q2, out, wb = b.step[q, mid]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            step[number[p, q], s] = (number[p2, q2], out, wa + wb)
    return Transducer(len(number), step)


# Symbols that the transducers write: a hit is HIT + the bits of what holds for it.
HIT, NEGATED, REPORTED, AIMED, THREATENS = 8, 1, 2, 4, 8
SYMBOLS = range(HIT + 16)
NEGATION_SCOPE, AIM_SCOPE = 3, 4


@dataclass
class Arcs:
    """Weights of the machine's arcs: what a hit weighs, and what is added where it is negated, reported, aimed or a threat."""

    hit: float = 1.0
    negated: float = -0.7
    reported: float = -0.4
    aimed: float = 0.5
    threat: float = -0.5

    def prior(self) -> np.ndarray:
        return np.array([self.hit, self.negated, self.reported, self.aimed, self.threat])


def _hits(arcs: Arcs) -> Transducer:
    """Names hits and weighs them."""
    step = {(0, s): (0, s, 0.0) for s in SYMBOLS}
    step[0, INSULT] = (0, HIT, arcs.hit)
    step[0, THREAT] = (0, HIT + THREATENS, arcs.hit + arcs.threat)
    return Transducer(1, step)


def _scoped(trigger: int, bit: int, weight: float, scope: int) -> Transducer:
    """Marks and weighs hits within ``scope`` words after a trigger."""
    step = {}
    for k in range(scope + 1):
        for s in SYMBOLS:
            if s == trigger:
                step[k, s] = (scope, s, 0.0)
            elif s >= HIT:
                step[k, s] = (max(0, k - 1), HIT + (s - HIT | bit) if k else s, weight if k else 0.0)
            else:
                step[k, s] = (max(0, k - 1), s, 0.0)
    return Transducer(scope + 1, step)


def _reported(weight: float) -> Transducer:
    """After a verb of saying, hits of the clause are someone else's."""
    return Transducer(2, {(k, s): (1 if s == REPORT else k, HIT + (s - HIT | REPORTED) if k and s >= HIT else s, weight if k and s >= HIT else 0.0) for k in (0, 1) for s in SYMBOLS})


def parts(arcs: Arcs) -> list[Transducer]:
    return [_hits(arcs), _scoped(NEGATION, NEGATED, arcs.negated, NEGATION_SCOPE), _reported(arcs.reported), _scoped(TARGET, AIMED, arcs.aimed, AIM_SCOPE)]


def grammar(arcs: Arcs | None = None) -> Transducer:
    machine, *rest = parts(arcs or Arcs())
    for part in rest:
        machine = compose(machine, part, SYMBOLS)
    return machine


LABELS = 16
FEATURES = LABELS + 4


@dataclass
class Lexicon:
    """Insult stems with their weight (log likelihood ratio); a stem that ends in ``$`` is a whole word."""

    weights: dict[str, float]
    arcs: Arcs = field(default_factory=Arcs)
    classes: dict[str, int] = field(default_factory=lambda: {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws})

    def insult(self, token: str) -> float:
        """Weight of the longest stem of a token, or 0."""
        if f"{token}$" in self.weights:
            return self.weights[f"{token}$"]
        for n in range(min(len(token), STEM_TO), STEM_FROM - 1, -1):
            if token[:n] in self.weights:
                return self.weights[token[:n]]
        return 0.0


class Matcher:
    """Scores the clauses of texts. Clauses without an insult stem or a threat are never looked at."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.machine = lexicon, grammar(lexicon.arcs).step
        self.finder = ahocorasick.Automaton()
        for stem in [*lexicon.weights, *(f"{t}$" for t in THREATS)]:
            word = stem.rstrip("$")
            self.finder.add_word(word, (len(word), stem[-1] == "$"))
        self.empty = not len(self.finder)
        if not self.empty:
            self.finder.make_automaton()

    def clause(self, clause: str) -> list[tuple[int, float, float]]:
        """(label bits, weight of the pattern, weight of the stem) of each hit of a lower-cased clause."""
        state, out = 0, []
        for token in TOKEN.findall(clause):
            stem = self.lexicon.insult(token)
            symbol = INSULT if stem else self.lexicon.classes.get(token, OTHER)
            state, said, weight = self.machine[state, symbol]
            bits = said - HIT
            if said >= HIT and (bits & AIMED or not bits & THREATENS):  # a threat is one only if aimed
                out.append((bits, weight, stem or 1.0))
        return out

    def clauses(self, text: str) -> list[tuple[int, int, list[tuple[int, float, float]]]]:
        """(start, end, hits) of the clauses with hits, in the lower-cased text."""
        low, out, upto = text.lower(), [], 0
        if self.empty:
            return out
        for end, (n, whole) in self.finder.iter(low):
            begin = end - n + 1
            if end < upto or begin and (low[begin - 1].isalnum() or low[begin - 1] == "_") or whole and end + 1 < len(low) and low[end + 1].isalnum():
                continue
            stop, done = CLAUSE_END.search(low, end + 1), upto
            upto = stop.start() if stop else len(low)
            start = max(low.rfind(c, done, begin) for c in ".!?;:\n") + 1  # no clause's text is looked at twice
            hits = self.clause(low[max(start, done) : upto])
            if hits:
                out.append((max(start, done), upto, hits))
        return out

    def features(self, text: str | None) -> list[float]:
        """Hits by label (log counts), the clauses' summed and largest weights, the strongest stem, and whether any clause weighs more than nothing."""
        count, best, total, stem = [0] * LABELS, 0.0, 0.0, 0.0
        for _, _, hits in self.clauses(text or ""):
            weight = sum(w * s for _, w, s in hits)
            best, total = max(best, weight), total + max(0.0, weight)
            stem = max([stem, *(s for _, _, s in hits)])
            for bits, _, _ in hits:
                count[bits] += 1
        return [*(np.log1p(c) for c in count), np.log1p(best), np.log1p(total), stem, float(best > 0)]


# --- learning -------------------------------------------------------------------


def _stems(text: str) -> set[str]:
    out = set()
    for w in {w for w in TOKEN.findall(text.lower()) if len(w) >= STEM_FROM}:
        out.update(w[:n] for n in range(STEM_FROM, min(len(w), STEM_TO) + 1))
        out.add(f"{w}$")
    return out


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, label: how many toxic and how many clean texts have each stem."""
    pos, neg = Counter(), Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        every = sorted(pos.keys() | neg.keys())
        for i in range(0, len(every), 20_000):
            some = every[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([pos[s] for s in some], pa.int64()), pa.array([neg[s] for s in some], pa.int64())], ["stem", "pos", "neg"])
        pos.clear()
        neg.clear()

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (pos if label else neg).update(_stems(text.as_py() or ""))
            if len(pos) + len(neg) > 500_000:
                yield from rows()
    yield from rows()


def learn_lexicon(sampled: DataFrame, least_ratio: float = 30.0, least_share: float = 0.004) -> Lexicon:
    """Word beginnings that toxic texts have at least ``least_ratio`` times as often as clean ones.

    Copies of a text count once. A stem must be in ``least_share`` of the sample's toxic
    texts, so there are at most 1 / least_share times as many as a text has on average.
    """
    texts = sampled.groupBy("text").agg(F.max("label").alias("label"))
    n = texts.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    if not n.p or not n.n:
        return Lexicon({})
    ratio = ((F.col("pos") + 0.5) / (n.p + 1)) / ((F.col("neg") + 0.5) / (n.n + 1))
    counted = texts.mapInArrow(_count_stems, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    with small_batches(sampled.sparkSession):
        found = counted.where((F.col("pos") >= max(4, least_share * n.p)) & (ratio >= least_ratio)).select("stem", "pos", ratio.alias("ratio")).orderBy(F.desc("pos"), "stem").collect()
    count = {r.stem: r.pos for r in found}
    weight = {r.stem: float(np.log(r.ratio)) for r in found}
    longer: dict[str, list[str]] = {}
    for s in count:
        up = s[:-1] if len(s.rstrip("$")) >= STEM_FROM else ""
        if s.endswith("$") and len(s) - 1 > STEM_TO:
            up = s[:STEM_TO]
        longer.setdefault(up, []).append(s)
    chosen = {}
    for s in count:
        if s[:-1] in count or s.endswith("$") and s[:STEM_TO] in count:
            continue  # a shorter stem covers it
        while True:
            keep = [x for x in longer.get(s, []) if count[x] >= 0.95 * count[s]]
            if not keep:
                break
            s = max(keep, key=lambda x: count[x])
        chosen[s] = weight[s]
    return Lexicon(chosen)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, prior: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge around ``prior`` (zero)."""
    a = np.column_stack((x, np.ones(len(x))))
    centre = np.append(np.zeros(x.shape[1]) if prior is None else prior, 0.0)
    w = centre.copy()
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (w - centre) ** 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * (w - centre)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def train(documents: DataFrame, labels: DataFrame, fold_of: int = 4, fold: int = 2, most_rows: int = 12_000) -> Model:
    """Learns from at most about ``most_rows`` labelled rows outside the held-out fold."""
    sampled = sample(documents, labels, "toxic", remainder(fold_of) != fold, most_rows)
    lexicon = learn_lexicon(sampled)

    def seen(lexicon: Lexicon):
        shared = documents.sparkSession.sparkContext.broadcast(lexicon)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([m.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

        with small_batches(documents.sparkSession):
            rows = sampled.mapInArrow(features, "x array<double>, label int").toPandas()
        return np.array(rows["x"].tolist()).reshape(len(rows), FEATURES), rows["label"].to_numpy(float)

    x, y = seen(lexicon)
    if len(set(y)) < 2:
        return Model(lexicon, np.zeros(FEATURES), float(np.log(0.05)))
    lexicon.arcs = fit_arcs(x, y)
    x, y = seen(lexicon)
    w, b = fit_logistic(x, y)
    return Model(lexicon, w, b)


def fit_arcs(x: np.ndarray, y: np.ndarray) -> Arcs:
    """Arc weights from texts' hits by label: what each mark adds to a hit's weight, near the prior where few hits have it."""
    count = np.expm1(x[:, :LABELS])
    marked = [count[:, [k for k in range(LABELS) if k & bit]].sum(axis=1) for bit in (NEGATED, REPORTED, AIMED, THREATENS)]
    hits = count.sum(axis=1)
    scale = max(fit_logistic(hits[:, None], y, ridge=1e-2)[0][0], 0.1)
    w, _ = fit_logistic(np.column_stack([hits, *marked]), y, prior=scale * Arcs().prior())
    return Arcs(1.0, *np.clip(w[1:] / max(w[0], 0.1), -1.5, 1.5).tolist())  # a plain hit weighs one


TOXIC = 0.3  # from this score on a text counts as toxic


def kept(documents: DataFrame, model: Model, threshold: float = TOXIC) -> DataFrame:
    """The rows whose text scores below the threshold, by default those that op7 does not predict as toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        m = Matcher(shared.value.lexicon)
        w, b = shared.value.weights, shared.value.bias
        for batch in batches:
            x = np.array([m.features(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) < threshold))

    return written(documents.mapInArrow(run, documents.schema), "kept", tasks_for(documents))


def score(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of documents, and the text's score between 0 and 1; null and empty texts score as texts without a hit."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*columns, F.col("text").cast("string").alias(free_name(columns, "text")))
    schema = rows.select(*columns).schema.add("score", "double")

    def run(frames):
        m = Matcher(shared.value.lexicon)
        w, b = shared.value.weights, shared.value.bias
        for batch in frames:
            x = np.array([m.features(t.as_py()) for t in batch.column(len(columns))]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(p)], [*columns, "score"])

    return rows.mapInArrow(run, schema)
