"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five weighted transducers rewrite a clause in turn: one may take an insult (stems learnt from labelled texts are its arcs, with
their weights), one a threat, one says whether the match has a target, one whether a negation reaches it, one whether it is
reported speech. Weights lie in one semiring (best path: sums along a path, the maximum over paths). The five are composed into
one machine; a clause's score under each label is the weight of its best accepting path that puts that label out. A text is
scored by the sums over its clauses through a fitted logistic curve. Sentences without a match are never walked: an Aho-Corasick
automaton over the stems finds those with one. What a sentence reports goes on over its commas and colons.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import slices
from labelwright.llm.fitting import held_out, sample, texts_of

#: Learnt from at most about this many texts of each label.
TEXTS_PER_LABEL = 1_000
#: A stem stands in so many toxic sample texts and in this share of them at least, and this many times as often in them as in others.
STEM_TEXTS, STEM_SHARE, STEM_RATIO, STEM_SHORT, STEM_LONG = 4, 0.025, 5.0, 4, 8
#: Closed-class words of the four languages, by their part in a clause.
TARGET = frozenset("you your yours yourself he him she her they them u tu te toi vous votre du dich dir euch ihr ihn sie usted ustedes tus vosotros".split())
NEGATION = frozenset("not no never isn aren wasn don doesn didn nor without nicht kein keine keinen nie niemals ohne pas jamais sans nunca jamás sin".split())
REPORTED = frozenset("said says say wrote writes called calls claimed quoted quotes according sagte sagt schrieb nannte laut dit écrit appelle selon dijo dice escribió llamó según".split())
THREAT = frozenset("kill hurt beat stab shoot destroy burn murder töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split())
#: Words over which a negation reaches.
REACH = 4
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
_SENTENCE = re.compile(r"[.!?\n]+")
_CLAUSE = re.compile(r"[,;:|()]+")

#: What a word is to the grammar; what the first two transducers make of a match; and the labels that the others give it.
OTHER, INSULT, MENACE, ADDRESS, DENIAL, REPORT, QUOTE, HIT, AIMED = range(9)
PLAIN, TARGETED, DENIED, SAID, THREATENED = LABELS = range(9, 14)
OUTPUTS = len(LABELS)
PASSED = (OTHER, ADDRESS, DENIAL, REPORT, QUOTE)
#: Weights of arcs: the semiring's one; a threat (as a stem of that weight); a target; being denied or reported.
ONE, THREAT_WEIGHT, TARGET_WEIGHT, LESS = 0.0, 1.0, 0.5, -0.5
#: Characters by which a text's length enters the curve: long texts meet stems by chance.
LENGTH, LENGTH_RIDGE, OUTPUT_RIDGE = 500, 20.0, 5.0
#: Sums of matches beyond this say no more.
ENOUGH = 10.0


@dataclass(frozen=True)
class Arc:
    """``takes``: whether the word's own weight is added to ``weight``."""

    to: int
    out: int
    weight: float = ONE
    takes: bool = False


@dataclass(frozen=True)
class Transducer:
    """Reads and writes one symbol an arc. Several arcs may leave a state under one symbol; a missing one ends a path."""

    arcs: dict[tuple[int, int], tuple[Arc, ...]]
    finals: frozenset[int]

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` makes of what this one writes. States are pairs (a * n + b), of any start; weights add along."""
        n = 1 + max(q for q, _ in other.arcs)
        arcs: dict[tuple[int, int], tuple[Arc, ...]] = {}
        for (a, x), own in self.arcs.items():
            for b in range(n):
                both = tuple(Arc(one.to * n + two.to, two.out, one.weight + two.weight, one.takes or two.takes) for one in own for two in other.arcs.get((b, one.out), ()))
                if both:
                    arcs[a * n + b, x] = both
        return Transducer(arcs, frozenset(a * n + b for a in self.finals for b in other.finals))


def insult() -> Transducer:
    """Takes one insult of the clause or none: 0 none yet, 1 one taken."""
    arcs = {(q, x): (Arc(q, OTHER if x == INSULT else x),) for q in (0, 1) for x in (*PASSED, MENACE, INSULT)}
    arcs[0, INSULT] += (Arc(1, HIT, ONE, True),)
    return Transducer(arcs, frozenset((0, 1)))


def threat() -> Transducer:
    """Takes one threat, if there is no insult taken, or none."""
    arcs = {(q, x): (Arc(q, OTHER if x == MENACE else x),) for q in (0, 1) for x in (*PASSED, MENACE)}
    arcs[0, MENACE] += (Arc(1, AIMED, THREAT_WEIGHT),)
    arcs[0, HIT] = (Arc(1, HIT),)
    return Transducer(arcs, frozenset((0, 1)))


def target() -> Transducer:
    """0 no target yet, 1 one met, 2 a match that needs one still to come, 3 a match that must have none. A threat needs one."""
    arcs = {(q, x): (Arc(q, x),) for q in range(4) for x in PASSED}
    arcs[0, ADDRESS] = arcs[1, ADDRESS] = arcs[2, ADDRESS] = (Arc(1, ADDRESS),)
    del arcs[3, ADDRESS]
    arcs[0, HIT], arcs[1, HIT] = (Arc(3, PLAIN), Arc(2, TARGETED, TARGET_WEIGHT)), (Arc(1, TARGETED, TARGET_WEIGHT),)
    arcs[0, AIMED], arcs[1, AIMED] = (Arc(2, THREATENED),), (Arc(1, THREATENED),)
    return Transducer(arcs, frozenset((0, 1, 3)))


def negation() -> Transducer:
    """The state is how many words the negation still reaches."""
    arcs = {}
    for q in range(REACH + 1):
        for x in (*PASSED, PLAIN, TARGETED, THREATENED):
            denied = q > 0 and x in LABELS
            arcs[q, x] = (Arc(REACH if x == DENIAL else max(0, q - 1), DENIED if denied else x, LESS if denied else ONE),)
    return Transducer(arcs, frozenset(range(REACH + 1)))


def report() -> Transducer:
    """Bit 1: a word of reporting was met; bit 2: inside quotation marks."""
    arcs = {}
    for q in range(4):
        for x in (*PASSED, *(y for y in LABELS if y != SAID)):
            said = q > 0 and x in LABELS
            arcs[q, x] = (Arc(q | 1 if x == REPORT else q ^ 2 if x == QUOTE else q, SAID if said else x, LESS if said else ONE),)
    return Transducer(arcs, frozenset(range(4)))


REPORTS = report()


def grammar() -> Transducer:
    """All five composed; a clause starts in the state whose report part the sentence so far gives."""
    return insult().compose(threat()).compose(target()).compose(negation()).compose(REPORTS)


@dataclass
class Grammar:
    """Fitted stems with weights, and the logistic curve. ``$`` ends a stem that must be a whole word."""

    stems: dict[str, float]
    curve: np.ndarray
    table: Transducer = field(default_factory=grammar)
    finder: object = None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def _kind(self, word: str) -> tuple[int, float]:
        if weight := self.stems.get(word + "$"):
            return INSULT, weight
        for n in range(min(len(word), STEM_LONG), STEM_SHORT - 1, -1):
            if weight := self.stems.get(word[:n]):
                return INSULT, weight
        for kind, words in ((MENACE, THREAT), (ADDRESS, TARGET), (DENIAL, NEGATION), (REPORT, REPORTED)):
            if word in words:
                return kind, 1.0
        return (QUOTE if not word.isalpha() else OTHER), 0.0

    def clause(self, words: list[tuple[int, float]], start: int = 0) -> list[float]:
        """For one clause (kinds and weights of its words): the best accepting path's weight under each label, 0 without one."""
        arcs, paths = self.table.arcs, {(start, 0): ONE}
        for kind, weight in words:
            ahead: dict[tuple[int, int], float] = {}
            for (state, label), so_far in paths.items():
                for arc in arcs.get((state, kind), ()):
                    key = arc.to, arc.out if arc.out in LABELS else label
                    total = so_far + arc.weight + (weight if arc.takes else ONE)
                    if total > ahead.get(key, -math.inf):
                        ahead[key] = total
            paths = ahead
        out = [0.0] * OUTPUTS
        for (state, label), total in paths.items():
            if label and state in self.table.finals:
                out[label - PLAIN] = max(out[label - PLAIN], total)
        return out

    def sentence(self, text: str) -> list[float]:
        """Sums over the clauses of one sentence (lower case)."""
        out, said = [0.0] * OUTPUTS, 0
        for part in _CLAUSE.split(text):
            words = [self._kind(w) for w in _WORD.findall(part)]
            if any(kind in (INSULT, MENACE) for kind, _ in words):
                out = [a + b for a, b in zip(out, self.clause(words, said), strict=True)]
            for kind, _ in words:
                if kind in (REPORT, QUOTE):
                    said = REPORTS.arcs[said, kind][0].to
        return out

    def matches(self, text: str | None) -> list[float]:
        """Sums over sentences with a match. A text without any is all zeros. Each character is looked at a few times."""
        total = [0.0] * OUTPUTS
        if not text:
            return total
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for word in itertools.chain((s.rstrip("$") for s in self.stems), THREAT):
                self.finder.add_word(word, len(word))
            self.finder.make_automaton()
        low = text.lower()
        left, stop = 0, _SENTENCE.search(low)
        done = -1
        for end, size in self.finder.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            while stop and stop.end() <= start:
                left, stop = stop.end(), _SENTENCE.search(low, stop.end())
            done = stop.start() if stop else len(low)
            total = [a + b for a, b in zip(total, self.sentence(low[left:done]), strict=True)]
        return total

    def inputs(self, text: str | None) -> list[float]:
        """What the curve weighs: 1, all matches' sum, each output's own beside it (but the plain one's), the length's logarithm."""
        found = self.matches(text)
        return [1.0, min(sum(found), ENOUGH) / 5, *(min(m, ENOUGH) / 5 for m in found[1:]), math.log1p(len(text or "") / LENGTH)]

    def score(self, text: str | None) -> float:
        x = sum(w * v for w, v in zip(self.curve.tolist(), self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn_stems(labelled: list[tuple[str, int]]) -> dict[str, float]:
    """Stems and whole words (``$``) that mark toxic texts, weighted by log odds of text counts.

    A stem must pass what chance would give by four deviations, in texts and in different neighbours, so copies of one text
    make no stem. A longer stem stays beside a shorter one only if it says clearly more. Equal texts count once.
    """
    texts = [(re.findall(r"[^\W\d_]+", t.lower()), y) for t, y in sorted(set(labelled))]
    size = Counter(y for _, y in texts)
    per_word = {y: Counter(w for words, z in texts if z == y for w in set(words)) for y in (0, 1)}

    def stems(word: str) -> list[str]:
        return [word[:n] for n in range(STEM_SHORT, min(len(word), STEM_LONG) + 1)] + [word + "$"]

    most, clean = Counter(), Counter()
    for s, n in ((s, n) for w, n in per_word[1].items() for s in stems(w)):
        most[s] += n
    for s, n in ((s, n) for w, n in per_word[0].items() for s in stems(w) if s in most):
        clean[s] += n
    likely = {s for s, n in most.items() if n >= STEM_TEXTS and 2 * n * size[0] >= STEM_RATIO * clean[s] * size[1]}
    own = {w: found for w in set(per_word[0]) | set(per_word[1]) if (found := [s for s in stems(w) if s in likely])}
    counts, places = {0: Counter(), 1: Counter()}, defaultdict(set)
    for words, y in texts:
        counts[y].update({s for w in words for s in own.get(w, ())})
        if y:
            for left, word, right in zip(["", *words], words, [*words[1:], ""], strict=False):
                for s in own.get(word, ()):
                    places[s].add((left, right))
    least = max(STEM_TEXTS, STEM_SHARE * size[1])
    found: dict[str, float] = {}
    for s, n in sorted(counts[1].items(), key=lambda x: (len(x[0]), x[0])):
        chance = (counts[0][s] + 1) / (size[0] + 1) * size[1]
        weight = math.log((n + 0.5) / (size[1] + 1)) - math.log((counts[0][s] + 0.5) / (size[0] + 1))
        if min(n, len(places[s])) < max(least, chance + 4 * math.sqrt(chance) + 2) or weight < math.log(STEM_RATIO):
            continue
        shorter = [s[:k] for k in range(STEM_SHORT, len(s)) if s[:k] in found]
        if any(n < 0.95 * counts[1][x] and weight < found[x] + 1 for x in shorter):
            continue
        for x in shorter:
            if n >= 0.95 * counts[1][x]:
                del found[x]
        found[s] = weight
    return found


def fit(labelled: list[tuple[str, int]], share: float | None = None, steps: int = 25, ridge: float = 0.1) -> Grammar:
    """Stems, and the curve by Newton's method with a small ridge.

    For the curve each half of the texts is matched with stems of the other half, so it doesn't trust them too much.

    ``share``: of label 1 among all labelled rows; the sample's labels weigh as half-way between it and the sample's own share.
    """
    y = np.array([t for _, t in labelled], float)
    model = Grammar(learn_stems(labelled), np.zeros(OUTPUTS + 2))
    if not len(y) or y.min() == y.max():
        model.curve[0] = 0.0 if not len(y) else 5.0 if y[0] else -5.0
        return model
    halves = [Grammar(learn_stems(labelled[k::2]), model.curve) for k in (1, 0)]
    x = np.array([halves[i % 2].inputs(t) for i, (t, _) in enumerate(labelled)])
    share = y.mean() if share is None else (share + y.mean()) / 2
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    curve = np.zeros(OUTPUTS + 2)
    penalty = np.diag([0.0, ridge] + [OUTPUT_RIDGE] * (OUTPUTS - 1) + [LENGTH_RIDGE])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ curve
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(OUTPUTS + 2)
        curve = curve - np.linalg.solve(bend, slope)
    model.curve = curve
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = TEXTS_PER_LABEL) -> Grammar:
    """Learn from labelled rows outside the held-out fold, about ``per_label`` texts of each label; other labels than 0 and 1 are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = rows.agg(F.avg("toxic")).first()[0]
    chosen = sample(rows, "toxic", per_label)
    return fit(texts_of(docs, chosen, "toxic", "int") if chosen else [], share)


def score(docs: DataFrame, model: Grammar, column: str = "toxicity") -> DataFrame:
    """The rows with ``column``: 0 to 1, higher for likelier toxic. Null and empty texts get the score of no match.

    Only the text is looked at, so repeated rows get one score and null ids stay. Other columns stay whatever their names, but one
    named ``column`` is replaced. An empty table stays empty. Very long texts take time in proportion to their length.
    Equally good paths under one label have one weight, so ties change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar_ = shared.value
        for batch in batches:
            yield pa.array([grammar_.score(t) for _, _, texts in slices(batch) for t in texts], pa.float64())

    return docs.withColumn(column, scored(F.col("text").cast("string")))
