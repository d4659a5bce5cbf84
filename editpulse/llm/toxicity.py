"""Toxic texts by a learned lexicon, its misspellings and the context they stand in."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import row_of
from editpulse.sources.staging import stage

#: Bound on the labelled rows that lexicon and weights are fitted on; more are thinned by a hash of their id.
TRAIN_ROWS = 20_000
#: Bound on the terms of the lexicon.
LEXICON = 500
THRESHOLD = 0.7
HELD_OUT_PART, HELD_OUT_REST = 3, 1
#: Tokens on each side of a term that its context is judged by.
WINDOW = 8
FOLDS = 5
MIN_USES, MIN_Z, MIN_WEIGHT, MAX_WEIGHT = 3, 3.2, 2.0, 8.0
_PRIOR = 0.5
_KNOWN_STATES = 1 << 16
_KNOWN_TOKENS = 1 << 18

# Marks around tokens, and words that speak of or to someone, in four languages.
_MARKS = ".,;:!?\"'()[]{}<>*_~`#$%&|/\\-+=^@…–—“”„‟«»‹›‘’‚¿¡"
_OPENING, _CLOSING = "“„«‹‘‚\"", "”“»›’\""
_REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes quoting word words term terms phrase phrases cited reported slur slurs"
    " sagte sagt schrieb nannte nennt zitat zitiert wort begriff"
    " dit écrit appelé appelle cite citation mot terme"
    " dijo dice escribió llamó llama cita palabra término".split()
)
_ADDRESSING = frozenset("you your you're youre u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tu usted ustedes".split())

FEATURES = ("open_exact", "open_misspelt", "quoted", "strongest", "density", "terms", "addressed")


def edits_allowed(term: str) -> int:
    """Levenshtein distance within which a token counts as a misspelling of the term."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all terms intersected with their trie, made deterministic on demand.

    A state is a set of (trie node, edits so far) with the fewest edits for each node. Nodes below
    which no term allows that many edits drop out, so most tokens end after a few letters. States
    and transitions are kept for later tokens and forgotten when there are too many, which changes
    no answer.
    """

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach = [-1]
        for term in sorted(terms):
            node, allowed = 0, edits_allowed(term)
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term:
                child = self.children[node].get(letter)
                if child is None:
                    child = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(-1)
                node = child
                self.reach[node] = max(self.reach[node], allowed)
            self.term[node] = term
        self._forget()

    def _forget(self) -> None:
        self._states: list[tuple[tuple[int, int], ...]] = []
        self._number: dict[tuple[tuple[int, int], ...], int] = {}
        self._steps: list[dict[str, int]] = []
        self._accepts: list[tuple[int, str] | None] = []
        self._state({0: 0})

    def _state(self, fewest: dict[int, int]) -> int:
        """The state of these nodes and all reached from them by leaving out letters of a term; -1 if none is left."""
        open_nodes = [(node, edits) for node, edits in fewest.items() if edits <= self.reach[node]]
        fewest = dict(open_nodes)
        while open_nodes:
            node, edits = open_nodes.pop()
            if fewest[node] < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.reach[child] and edits + 1 < fewest.get(child, 99):
                    fewest[child] = edits + 1
                    open_nodes.append((child, edits + 1))
        if not fewest:
            return -1
        key = tuple(sorted(fewest.items()))
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
            ends = [(edits, self.term[node]) for node, edits in key if self.term[node] is not None and edits <= edits_allowed(self.term[node])]
            self._accepts.append(min(ends, default=None))
        return number

    def _step(self, state: int, letter: str) -> int:
        fewest: dict[int, int] = {}
        for node, edits in self._states[state]:
            child = self.children[node].get(letter)
            if child is not None and edits < fewest.get(child, 99):
                fewest[child] = edits
            if edits < self.reach[node]:
                for target in (node, *self.children[node].values()):  # the token has a letter more, or another one
                    if edits + 1 < fewest.get(target, 99):
                        fewest[target] = edits + 1
        found = self._steps[state][letter] = self._state(fewest)
        return found

    def nearest(self, token: str) -> tuple[int, str] | None:
        """Edits and term of the closest term within its allowed distance (the first of equally close ones)."""
        if len(self._states) > _KNOWN_STATES:
            self._forget()
        state = 0 if self._states else -1
        for letter in token:
            if state < 0:
                return None
            known = self._steps[state].get(letter)
            state = self._step(state, letter) if known is None else known
        return self._accepts[state] if state >= 0 else None


class Counted(NamedTuple):
    """Uses of a token in toxic and in other texts, by fold."""

    toxic: tuple[int, ...]
    other: tuple[int, ...]

    def without(self, fold: int | None) -> tuple[int, int]:
        toxic, other = sum(self.toxic), sum(self.other)
        return (toxic, other) if fold is None else (toxic - self.toxic[fold], other - self.other[fold])


class Lexicon(NamedTuple):
    """Uses of terms, of misspellings seen in training, and of all tokens."""

    terms: dict[str, Counted]
    misspelt: dict[str, Counted]
    uses: Counted

    def weight(self, term: str, fold: int | None = None) -> float:
        """Log odds of the term in toxic texts against others, by the uses outside ``fold``."""
        (a, b), (m, n) = self.terms[term].without(fold), self.uses.without(fold)
        odds = math.log((a + _PRIOR) / (m - a + _PRIOR)) - math.log((b + _PRIOR) / (n - b + _PRIOR))
        return min(max(odds, 0.0), MAX_WEIGHT)

    def misspelt_weight(self, token: str, term: str, fold: int | None = None) -> float:
        """Half the term's log odds, moved by the uses of this misspelling that were seen."""
        odds = math.exp(self.weight(term, fold) / 2)
        seen = self.misspelt.get(token)
        if seen is not None:
            (a, b), (m, n) = seen.without(fold), self.uses.without(fold)
            odds = (a * max(n, 1) / max(m, 1) + _PRIOR * odds) / (b + _PRIOR)
        return max(math.log(odds), 0.0)


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def quotation(tokens: list[str], place: int) -> float:
    """How much the window around a token looks like a quotation (1) and not like abuse (0).

    Quotation marks that open before the token, or at it, and close after it count most, then words
    of reporting; words that address the reader count against both.
    """
    before, after = tokens[max(0, place - WINDOW) : place], tokens[place + 1 : place + 1 + WINDOW]
    own = tokens[place]
    bare = {t.strip(_MARKS) for t in before} | {t.strip(_MARKS) for t in after}
    inside = False
    for token in (*before, own):
        if token[0] in _OPENING:
            inside = True
        if token is not own and token.rstrip(".,;:!?")[-1:] in _CLOSING and len(token) > 1:
            inside = False
    closes = any(t.rstrip(".,;:!?")[-1:] in _CLOSING for t in (own, *after))
    score = 1.0 * (inside and closes) + 0.5 * bool(bare & _REPORTING) - 0.5 * bool(bare & _ADDRESSING)
    return min(max(score, 0.0), 1.0)


def open_uses(text: str | None, tokens: list[str], places: Iterable[int]) -> list[dict]:
    """Bare tokens at these places that are not quoted, each with a hash of its two neighbours."""
    marked = any(mark in (text or "") for mark in _OPENING)
    found = set()
    for k in places:
        bare = tokens[k].strip(_MARKS)
        if bare and bare not in _REPORTING and bare not in _ADDRESSING and not (marked and quotation(tokens, k) == 1):
            around = f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}"
            found.add((bare, xxhash.xxh3_64_intdigest(around.encode()) >> 1))
    return [{"token": token, "around": around} for token, around in sorted(found)]


class Scanner:
    """Finds terms and misspellings in texts and sums up their weights by context."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = LexiconAutomaton(lexicon.terms)
        self.known: dict[str, tuple[int, str, str] | None] = {}

    def hits(self, tokens: list[str]) -> list[tuple[int, int, str, str]]:
        """Place, edits, term and bare token of every hit."""
        known, found = self.known, []
        if len(known) > _KNOWN_TOKENS:
            known.clear()
        for token in set(tokens):
            if token not in known:
                bare = token.strip(_MARKS)
                best = self.automaton.nearest(bare) if bare else None
                known[token] = best and (*best, bare)
        for place, token in enumerate(tokens):
            hit = known[token]
            if hit is not None:
                found.append((place, *hit))
        return found

    def features(self, text: str | None, fold: int | None = None) -> list[float]:
        tokens = tokens_of(text)
        exact = misspelt = quoted = strongest = addressed = 0.0
        terms = set()
        for place, edits, term, bare in self.hits(tokens):
            weight = self.lexicon.misspelt_weight(bare, term, fold) if edits else self.lexicon.weight(term, fold)
            if weight <= 0:
                continue
            share = quotation(tokens, place)
            quoted += weight * share
            meant = weight * (1 - share)
            strongest = max(strongest, meant)
            if edits:
                misspelt += meant
            else:
                exact += meant
            if share < 1:
                terms.add(term)
            around = tokens[max(0, place - WINDOW) : place + 1 + WINDOW]
            addressed += meant * any(t.strip(_MARKS) in _ADDRESSING for t in around)
        density = 100 * (exact + misspelt) / max(len(tokens), 1)
        return [math.log1p(x) for x in (exact, misspelt, quoted, strongest, density, len(terms), addressed)]


class Model(NamedTuple):
    lexicon: Lexicon
    intercept: float
    weights: tuple[float, ...]


def held_out() -> Column:
    """Whether a row's label is never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_PART == HELD_OUT_REST, F.lit(False))


def _training_texts(documents: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """label, fold and text of a bounded number of labelled rows; equal texts of one label count once."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total, part = known.count(), 1 << 30
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < round(part * min(1.0, train_rows / max(total, 1))))
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    return stage(rows.dropDuplicates(["label", "text"]).select("label", fold, "text"), "toxic-train")


def _uses(train: DataFrame, find) -> DataFrame:
    """token and its numbers of uses by label and fold; ``find`` gives the open uses of a text.

    Uses between the same two neighbours count once in each class, for the first fold: words of a passage
    that many texts copy are no evidence of their own.
    """
    use_type = pa.list_(pa.struct([("token", pa.string()), ("around", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = find()
        for part in w.slices(batches, "text"):
            found = pa.array([search(text) for text in part.column("text").to_pylist()], use_type)
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("fold"), found], names=["label", "fold", "uses"])

    each = train.mapInArrow(run, "label int, fold int, uses array<struct<token:string,around:long>>").select("label", "fold", F.inline("uses"))
    once = each.groupBy("token", "label", "around").agg(F.min("fold").alias("fold"))
    return once.groupBy("token").agg(*(F.count(F.when((F.col("label") == label) & (F.col("fold") == k), 1)).alias(f"n{label}_{k}") for label in (1, 0) for k in range(FOLDS)))


def _counted(row) -> Counted:
    return Counted(*(tuple(row[f"n{label}_{k}"] or 0 for k in range(FOLDS)) for label in (1, 0)))


def learn_lexicon(train: DataFrame, size: int = LEXICON) -> Lexicon:
    """Terms whose open use tells toxic texts by its log odds, the surest first, and the misspellings seen of them."""

    def all_uses():
        def search(text: str) -> list[dict]:
            tokens = tokens_of(text)
            return open_uses(text, tokens, range(len(tokens)))

        return search

    counted = stage(_uses(train, all_uses), "toxic-uses")
    names = [f"n{label}_{k}" for label in (1, 0) for k in range(FOLDS)]
    uses = _counted(counted.agg(*(F.sum(n).alias(n) for n in names)).head())
    toxic, other = (sum(x) for x in uses)
    a, b = (F.expr("+".join(f"n{label}_{k}" for k in range(FOLDS))) for label in (1, 0))
    odds = F.log((a + _PRIOR) / (toxic - a + _PRIOR)) - F.log((b + _PRIOR) / (other - b + _PRIOR))
    z = odds / F.sqrt(1 / (a + _PRIOR) + 1 / (b + _PRIOR))
    sure = counted.where((a >= MIN_USES) & (z >= MIN_Z) & (odds >= MIN_WEIGHT)).orderBy(z.desc(), "token").limit(size)
    lexicon = Lexicon({r["token"]: _counted(r) for r in sure.collect()}, {}, uses)

    def misspelt_uses():
        scanner = Scanner(lexicon)

        def search(text: str) -> list[dict]:
            tokens = tokens_of(text)
            return open_uses(text, tokens, [place for place, edits, _, _ in scanner.hits(tokens) if edits])

        return search

    return lexicon._replace(misspelt={r["token"]: _counted(r) for r in _uses(train, misspelt_uses).collect()})


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Lexicon and feature weights from ``labels`` (doc_id, toxic) outside the held-out part; None without both classes.

    Each training text is described by term weights of the other folds, so that the regression does
    not take terms for sure that were chosen by this very text.
    """
    train = _training_texts(documents, labels, train_rows)
    if train.select("label").distinct().count() < 2:
        return None
    lexicon = learn_lexicon(train)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for part in w.slices(batches, "text"):
            rows = zip(part.column("text").to_pylist(), part.column("fold").to_pylist(), strict=True)
            found = pa.array([scanner.features(text, fold) for text, fold in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.float64()), found], names=["label", "x"])

    described = stage(train.mapInArrow(describe, "label double, x array<double>"), "toxic-features")
    model = LogisticRegression(maxIter=60, regParam=1e-3, featuresCol="features").fit(described.select("label", array_to_vector("x").alias("features")))
    return Model(lexicon, float(model.intercept), tuple(model.coefficients.toArray().tolist()))


def score_toxicity(documents: DataFrame, labels: DataFrame, carry: Iterable[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``row`` (the columns ``carry``, all by default),
    ``score``, the probability that ``labels`` (doc_id, toxic) call it toxic, and ``hits``: place,
    term, edits and quotation score of every term found, exact or misspelt.

    Tokens are lower-cased, split at white space and stripped of marks. The lexicon is learned: the
    terms whose use outside quotations raises the odds of a toxic label most surely. Tokens within one edit of a
    term of four letters, or two of one of eight, are misspellings; they weigh half, less if texts
    with other labels use them. Uses between the same neighbours count once, so copied passages
    make no terms. The window around each hit separates quotation from abuse, and a
    logistic regression weighs both.

    At most ``train_rows`` labelled rows are learned from and ``LEXICON`` terms kept; every whole
    text is scored, one by one, without a shuffle. Null and empty texts get the score of a text without
    any term. Without labels of both classes every score is 0.5. A document labelled twice counts
    as toxic if either label does. Ties between terms at one distance go to the first by code
    points. Repeated rows get equal scores. Empty tables give empty results. Other columns are not
    read unless carried.
    """
    model = fit(documents, labels, train_rows)
    hit_type = pa.list_(pa.struct([("place", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quotation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon) if model else None
        for part in w.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            if model is None:
                scores, found = np.full(len(texts), 0.5), [[] for _ in texts]
            else:
                x = np.array([scanner.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
                scores = 1 / (1 + np.exp(-(model.intercept + x @ np.array(model.weights))))
                found = []
                for tokens in map(tokens_of, texts):
                    found.append([{"place": p, "term": term, "edits": e, "quotation": quotation(tokens, p)} for p, e, term, _ in scanner.hits(tokens)])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores), pa.array(found, hit_type)], names=["row", "score", "hits"])

    frame = documents.select(row_of(documents, carry), "text")
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, score double, hits array<struct<place:int,term:string,edits:int,quotation:double>>")
