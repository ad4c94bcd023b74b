"""Toxicity scores from a lexicon with misspellings and context.

``learn_lexicon`` takes the words that labelled toxic documents use far more often than others
(smoothed odds of document frequencies). ``Automaton`` puts the terms into a trie and
intersects it with Levenshtein automata (a swap of two neighbours is one edit): a state is a set
of (trie node, edits), determinized once in a worker into a table, so a word is matched by one
table walk, and many words at a time by numpy. Longer terms allow more edits. Words keep digits
and symbols between letters (st*pid, id1ot) and letters that stand alone are joined (s-c-u-m);
where such a form is near no term, its parts are looked up. A word that labelled clean documents use
(``innocent``) is no misspelling; the model learns from each labelled text twice, once as if its
terms were misspelled. ``features`` walks whole texts and scores windows of words: hits in quotation marks or near words of reporting count as quoted, dense runs
of hits and hits near a form of address count as abuse. A logistic regression over these
features gives the score.

Defined results: null and empty texts have no hits and get the score of a text without hits;
labels that are null are ignored, repeated labels of a document count as the worst; without
both kinds of labels the score is 0; repeated rows are scored alike; extra columns are
ignored; an empty table gives an empty result. Scores use the text alone.

Labels are fitted on about ``max_labels`` rows at most, chosen by hash of their id; that bounds the
broadcast of labels and the lexicon: a term is a word of ``min_share`` of the toxic documents,
so there are at most 1 / ``min_share`` times the distinct words of a toxic text. Innocent words
are words of these rows, too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import IdTable, groups
from .common import put, ship

#: Words of reporting and of address, in four languages.
REPORT = "said says quote quoted called wrote word term sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split()
ADDRESS = "you your youre du dich dir ihr tu te toi vous tú ti usted vosotros".split()
WINDOW = 8
CACHE = 250_000
FEATURES = ("hits", "strong", "near", "quoted", "density", "address", "kinds")


@dataclass(frozen=True)
class Toxicity:
    max_labels: int = 200_000
    min_docs: int = 3
    min_share: float = 0.02        # of the toxic documents; so the terms are at most 50 times the words of a toxic text
    min_odds: float = 8.0


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic product of a lexicon trie with Levenshtein automata of its terms.

    A state holds the fewest edits by place; a place is a node or, halfway through a swap, the node
    behind the two letters with the letter still to come. ``match`` gives, for each word, the number
    of the nearest term (-1: none) and its edits."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        letters = sorted({c for t in terms for c in t})
        self.codes = {c: k + 1 for k, c in enumerate(letters)}       # 0: any other character
        kids, ends, budget, depth = [{}], [-1], [0], [0]
        for no, t in enumerate(terms):
            at = 0
            for c in t:
                if c not in kids[at]:
                    kids[at][c] = len(kids)
                    kids.append({})
                    ends.append(-1)
                    budget.append(0)
                    depth.append(depth[at] + 1)
                at = kids[at][c]
            ends[at] = no
        for k in range(len(kids) - 1, -1, -1):      # most edits that a term below allows
            budget[k] = max([edits(terms[ends[k]]) if ends[k] >= 0 else 0, *[budget[j] for j in kids[k].values()]])

        def close(state):
            """Adds skipped letters of the term, keeps the fewest edits per node."""
            best = {}
            todo = sorted(state.items(), key=lambda s: s[1])
            while todo:
                place, e = todo.pop()
                swap = isinstance(place, tuple)
                if e > budget[place[0] if swap else place] or best.get(place, 99) <= e:
                    continue
                best[place] = e
                if not swap:
                    todo += [(j, e + 1) for j in kids[place].values()]
            return frozenset(best.items())

        start = close({0: 0})
        self.table, accept, number, todo = [], [], {start: 0}, [start]
        while todo:
            state = todo.pop(0)
            swaps = [(p, e) for p, e in state if isinstance(p, tuple)]
            state = [(n, e) for n, e in state if not isinstance(n, tuple)]
            near = min(((e, ends[n]) for n, e in state if ends[n] >= 0 and e <= edits(terms[ends[n]])), default=(0, -1))
            accept.append(near)
            moves: dict = {}
            other: dict = {}
            for node, e in state:
                other[node] = min(other.get(node, 99), e + 1)                 # a letter too many
                for c, j in kids[node].items():
                    other[j] = min(other.get(j, 99), e + 1)                   # another letter
            for node, e in state:
                for first, j in kids[node].items():
                    for c, k in kids[j].items():
                        if c != first and e < budget[k]:
                            to = moves.setdefault(c, dict(other))
                            to[k, first] = min(to.get((k, first), 99), e + 1)
            for (node, c), e in swaps:
                to = moves.setdefault(c, dict(other))
                to[node] = min(to.get(node, 99), e)
            for c in {c for n, _ in state for c in kids[n]}:
                moves.setdefault(c, dict(other))
                for node, e in state:
                    if c in kids[node]:
                        moves[c][kids[node][c]] = min(moves[c].get(kids[node][c], 99), e)
            row = [self._number(close(other), number, todo)] * (len(letters) + 1)
            for c, s in moves.items():
                row[self.codes[c]] = self._number(close(s), number, todo)
            self.table.append(row)
        self.table = np.array(self.table, np.int32)
        self.edits, self.term = (np.array(x, np.int32) for x in zip(*accept))
        self.longest = max(map(len, terms), default=0) + 2

    @staticmethod
    def _number(state, number, todo):
        if state not in number:
            number[state] = len(number)
            todo.append(state)
        return number[state]

    def match(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        term, cost = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int32)
        fit = np.flatnonzero(size <= self.longest)
        if not len(fit):
            return term, cost
        text = "".join([words[k] for k in fit.tolist()])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seen, back = np.unique(points, return_inverse=True)
        codes = np.array([self.codes.get(chr(c), 0) for c in seen.tolist()], np.int64)[back]
        ends = np.cumsum(size[fit])
        state = np.zeros(len(fit), np.int32)
        for k in range(int(size[fit].max())):
            go = np.flatnonzero(size[fit] > k)
            state[go] = self.table[state[go], codes[(ends - size[fit])[go] + k]]
        term[fit], cost[fit] = self.term[state], self.edits[state]
        return term, cost


#: The automaton of the last lexicon that this worker met.
_LAST: list = [None, None]


def automaton(terms: list[str]) -> Automaton:
    if _LAST[0] != terms:
        _LAST[:] = [list(terms), Automaton(terms)]
    return _LAST[1]


class Scorer:
    """Context features of whole texts."""

    #: Letters that stand alone, joined by the same kind of sign; letters with single digits or signs between; quotes.
    _TOKEN = re.compile(r"(?<!\w)[^\W\d_](?:[-._*+][^\W\d_]){2,}(?!\w)|(?<!\w)[^\W\d_](?: [^\W\d_]){3,}(?!\w)"
                        r"|[^\W\d_]+(?:[\d*@$!#+][^\W\d_]+)*|[\"“”„«»]")
    _ALONE = re.compile(r"[^\W\d_](?:[-._*+ ][^\W\d_]){2,}")
    _PARTS = re.compile(r"[^\W\d_]+")

    def __init__(self, terms: list[str], weights: list[float], innocent: frozenset = frozenset()):
        self.automaton, self.weights, self.innocent = automaton(terms), np.array([*weights, 0.0]), innocent
        self.words = IdTable()
        self.term, self.cost, self.kind = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)

    def look_up(self, words: list[str]):
        """Number of the nearest term (-1: none) and its edits, for tokens of ``_TOKEN``."""
        plain = [w if w.isalpha() else "".join(self._PARTS.findall(w)) if self._ALONE.fullmatch(w) else w for w in words]
        term, cost = self.automaton.match(plain)
        term[[k for k in np.flatnonzero(cost > 0).tolist() if plain[k] in self.innocent]] = -1
        parts = [(k, p) for k in np.flatnonzero(term < 0).tolist() if not plain[k].isalpha() for p in self._PARTS.findall(plain[k])]
        if parts:
            t, c = self.look_up([p for _, p in parts])
            for (k, _), t1, c1 in zip(parts, t.tolist(), c.tolist()):
                if t1 >= 0 and (term[k] < 0 or c1 < cost[k]):
                    term[k], cost[k] = t1, c1
        return term, cost

    def features(self, texts: list, misspelled: bool = False):
        """``misspelled``: as if no term had been met exactly."""
        if len(self.words) > CACHE:
            self.words.clear()
            self.term, self.cost, self.kind = self.term[:0], self.cost[:0], self.kind[:0]
        found = [self._TOKEN.findall((t or "").lower()) for t in texts]
        numbers = self.words.numbers([w for ws in found for w in ws])
        if self.words.new:
            new = self.words.new
            term, cost = self.look_up(new)
            kind = np.fromiter((1 if w in REPORT else 2 if w in ADDRESS else 3 if w in "\"“”„«»" else 0 for w in new), np.int8, len(new))
            self.term, self.cost, self.kind = (np.concatenate(x) for x in ((self.term, term), (self.cost, cost), (self.kind, kind)))
            self.words.new = []
        out = np.zeros((len(texts), len(FEATURES)))
        at = 0
        for d, ws in enumerate(found):
            own = numbers[at:at + len(ws)]
            at += len(ws)
            term = self.term[own]
            hit = np.flatnonzero(term >= 0)
            if not len(hit):
                continue
            cost = np.maximum(self.cost[own[hit]], int(misspelled))
            exact = cost == 0
            kind = self.kind[own]
            quote = np.cumsum(kind == 3)
            lo, hi = np.maximum(hit - WINDOW, 0), np.minimum(hit + WINDOW + 1, len(ws))
            report, address = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2))
            quoted = (quote[hit] % 2 == 1) & (quote[hit] < quote[-1]) | (report[hi] - report[lo] > 0)
            spoken = address[hi] - address[lo] > 0
            run = np.concatenate([[0], np.cumsum(term >= 0)])
            w = self.weights[term[hit]] * 0.5 ** cost
            out[d] = (np.log1p((exact & ~quoted).sum()), np.log1p((w * ~quoted).sum()), np.log1p((~exact & ~quoted).sum()),
                      np.log1p(quoted.sum()), (run[hi] - run[lo]).max() / WINDOW, np.log1p(spoken.sum()), np.log1p(len(np.unique(term[hit]))))
        return out


def training_labels(labels: DataFrame, tox: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, toxic of the rows that may be learned from, about ``max_labels`` at most."""
    d = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, tox.max_labels / max(1, d.count()))
    return d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def held_out(col: str):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5)) == 0


def word_counts(docs: DataFrame, train: DataFrame, tox: Toxicity = Toxicity()) -> DataFrame | None:
    """w, t, c (labelled documents with the word, toxic and clean) and odds; None without both kinds of labels."""
    # training_labels bounds the broadcast
    d = docs.join(F.broadcast(train), "doc_id").select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("w"))
    sizes = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = int(sizes[0] or 0), int(sizes[1] or 0)
    if not bad or not good:
        return None
    words = d.where("length(w) BETWEEN 3 AND 40").groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1))
    return words.withColumn("odds", odds).withColumn("enough", F.col("t") >= max(tox.min_docs, int(tox.min_share * bad)))


def strongest(words: DataFrame, tox: Toxicity = Toxicity()) -> list[tuple[str, float]]:
    words = words.where("enough").where(F.col("odds") >= tox.min_odds)
    return [(r.w, float(np.log(r.odds))) for r in words.orderBy(F.desc("odds"), F.desc("t"), "w").collect()]


def learn_lexicon(docs: DataFrame, train: DataFrame, tox: Toxicity = Toxicity()) -> list[tuple[str, float]]:
    """Terms and weights (log odds), the strongest first (of equal ones the most frequent). Odds
    and support alone decide: every word of ``min_share`` of the toxic documents and ``min_odds``."""
    words = word_counts(docs, train, tox)
    return [] if words is None else strongest(words, tox)


def innocent(words: DataFrame, lexicon: list[tuple[str, float]], tox: Toxicity = Toxicity()) -> frozenset:
    """Words near a term that are common words: in ``min_docs`` clean documents, without the odds of a term."""
    import pyarrow as pa
    ship(words.sparkSession)
    terms = [t for t, _ in lexicon]

    def run(batches):
        for b in batches:
            term, cost = automaton(terms).match(b.column("w").to_pylist())
            yield b.filter(pa.array((term >= 0) & (cost > 0)))

    usual = words.where((F.col("c") >= tox.min_docs) & (F.col("odds") < tox.min_odds)).select("w")
    return frozenset(r.w for r in usual.mapInArrow(run, "w string").collect())


def features(docs: DataFrame, lexicon: list[tuple[str, float]], usual: frozenset = frozenset(), misspelled: bool = False) -> DataFrame:
    """doc_id, features (array of double) of every document; map-only."""
    import pyarrow as pa
    ship(docs.sparkSession)
    terms, weights = [t for t, _ in lexicon], [w for _, w in lexicon]

    def run(batches):
        scorer = Scorer(terms, weights, usual)
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [scorer.features(texts[lo:hi], misspelled) for lo, hi in groups(texts, 1_000_000)]
            flat = np.concatenate([np.zeros((0, len(FEATURES))), *rows])
            offs = (np.arange(len(flat) + 1) * len(FEATURES)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.reshape(-1)))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, features array<double>")


def score(docs: DataFrame, labels: DataFrame, tox: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    train = put(training_labels(labels, tox), "labels")
    words = word_counts(docs, train, tox)
    if words is not None:
        words = put(words, "words")
    lexicon = [] if words is None else strongest(words, tox)
    usual = innocent(words, lexicon, tox) if lexicon else frozenset()
    feats = put(features(docs, lexicon, usual), "features")
    out = feats.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "features")
    if not lexicon:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    labelled = docs.select("doc_id", "text").join(F.broadcast(train.select("doc_id")), "doc_id")
    seen = feats.join(F.broadcast(train.select("doc_id")), "doc_id").select("doc_id", "features").unionByName(features(labelled, lexicon, usual, misspelled=True))
    seen = put(seen, "seen").join(F.broadcast(train), "doc_id").select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(seen)
    # the fitted function as an expression: a sum over the features
    z = " + ".join([repr(float(model.intercept)) + "D", *[f"features[{k}] * {float(w)!r}D" for k, w in enumerate(model.coefficients)]])
    return out.select("doc_id", "held_out", F.expr(f"1D / (1D + exp(-({z})))").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
