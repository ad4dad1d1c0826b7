"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Two words are compared by the letter triples they share as subsequences, each weighted by how
far it is spread, so letters put between or left out of an insult lower the kernel a
little and do not hide it. Words learn from the labels of the documents they occur in. The machine
that scores is trained on whole labelled documents: the sum of the maps of all their words, and the
decisions of their most toxic words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.quality import remainder
from panelcast.llm.shared import cuts, table, written

#: Weight of one letter place that a triple spans, and the most places it may span.
DECAY = 0.5
SPAN = 6
#: Letters of a word that are compared at once; longer words are read in overlapping windows.
WIDTH = 24
LANDMARKS = 160
#: Labelled documents that are learnt from, at most, and words of them that are trained on.
TRAIN_DOCS = 20_000
TRAIN_WORDS = 8_000
#: Times that the top words of clean documents are added as negative examples.
ROUNDS = 2
#: Decisions of the most toxic words of a document that its machine sees.
TOPS = 5
#: Weight on the coefficients of the machine of documents, over features of equal spread.
DOCUMENT_PENALTY = 1e-2
#: Words that are mapped at once: their rows of the map stay in the processor's cache.
MAPPED = 64
#: Word maps that a worker remembers while it reads the training documents.
MAPS = 100_000

_SYMBOLS = 32
#: Signs that stand for letters inside a word.
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ .*_-]+[^\W\d_](?!\S)){2,}")

#: The last two letters of such a run: quick to rule out.
_LAST_TWO = re.compile(r"[ .*_-][^\W\d_] [ .*_-]*[^\W\d_](?!\S)")


def units(text: str | None) -> list[str]:
    """Words of a whole text; letters spelled one by one count as a word too."""
    text = text or ""
    found = text.split()
    if _LAST_TWO.search(text) and _SPACED.search(text):
        found += ["".join(c for c in m if c.isalpha()) for m in _SPACED.findall(text)]
    return found


def normal(word: str) -> str:
    """Lower case without marks and digits at the ends; a word without letters is empty."""
    return _EDGES.sub("", word.lower())


def code(letter: str) -> int:
    """1 to 29 for letters, 0 for a place that matches nothing."""
    letter = _LOOKALIKES.get(letter, letter)
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 + ord(letter) % 3 if letter.isalpha() else 0


#: Code of each code point, -1 until it is met.
_CODES = np.full(0x110000, -1, np.int8)


def code_rows(words: list[str]) -> np.ndarray:
    """One row for each of some words of equal length: 30 and 31 for the ends of the word, its letters between."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = _CODES[points]
    for p in np.unique(points[inner < 0]):
        _CODES[p] = code(chr(p))
    out = np.empty((len(words), len(words[0]) + 2), np.int32)
    out[:, 0], out[:, -1] = 30, 31
    out[:, 1:-1] = _CODES[points].reshape(len(words), -1)
    return out


def codes(word: str) -> list[int]:
    """The row of one word."""
    return code_rows([word])[0].tolist()


def windows(word: str) -> list[str]:
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [
        (i, j, k, DECAY ** (k - i + 1))
        for i in range(length)
        for j in range(i + 1, length)
        for k in range(j + 1, min(length, i + SPAN))
    ]
    i, j, k, w = zip(*found, strict=True) if found else ((), (), (), ())
    return np.array(i, int), np.array(j, int), np.array(k, int), np.array(w, float)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: places of the words, triple codes (0 for none), weights with equal codes summed."""
    by_length: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        by_length.setdefault(len(word), []).append(at)
    for length, places in by_length.items():
        i, j, k, w = _triples(length + 2)
        if not len(i):
            continue
        for low in range(0, len(places), 20_000):
            some = places[low : low + 20_000]
            c = code_rows([words[p] for p in some])
            a, b, d = c[:, i], c[:, j], c[:, k]
            code = np.where((a > 0) & (b > 0) & (d > 0), (a * _SYMBOLS + b) * _SYMBOLS + d, 0)
            order = np.argsort(code, axis=1, kind="stable")
            code = np.take_along_axis(code, order, axis=1)
            total = np.cumsum(w[order], axis=1)
            last = np.concatenate([code[:, 1:] != code[:, :-1], np.ones((len(some), 1), bool)], axis=1)
            # Sums of equal neighbours: differences of the running total at the last of each.
            before = np.maximum.accumulate(np.where(last, total, 0), axis=1)
            before = np.concatenate([np.zeros((len(some), 1)), before[:, :-1]], axis=1)
            weight = np.where(last & (code > 0), total - before, 0.0)
            yield np.array(some), code, weight


@dataclass(frozen=True)
class Triples:
    """Normalised features of some words: word number, triple code and weight of each entry."""

    n: int
    word: np.ndarray
    code: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Triples:
        parts = []
        for places, code, weight in features(words):
            norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
            at = weight > 0
            parts.append((np.repeat(places, at.sum(axis=1)), code[at], (weight / np.where(norm > 0, norm, 1))[at]))
        word, code, weight = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, int),) * 3
        return Triples(len(words), word, code, weight)

    def dense(self, at: int) -> np.ndarray:
        mine = self.word == at
        return np.bincount(self.code[mine], self.weight[mine], _SYMBOLS**3)

    def kernel(self, other: np.ndarray) -> np.ndarray:
        """Kernel of every word with one dense word."""
        return np.bincount(self.word, other[self.code] * self.weight, self.n)


@dataclass(frozen=True)
class ToxicityModel:
    """Decision weights of words over letter triples, and the machine of documents.

    ``evidence`` holds what a word adds to its document, over letter triples; ``tops`` the
    weights of the top decisions; ``usual`` is what a word adds on average. ``slope`` and ``offset`` lead to a probability.
    """

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    evidence: np.ndarray | None = None
    tops: tuple[float, ...] = (1.0, *[0.0] * (TOPS - 1))
    usual: float = 0.0

    def decide(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distance from the separating plane of words, and what they add to their document.

        Words without a triple have the bias and add nothing.
        """
        out, adds = np.full(len(words), self.bias), np.zeros(len(words))
        for places, code, weight in features(words):
            norm = np.sqrt((weight**2).sum(axis=1))
            norm = np.where(norm > 0, norm, 1)
            out[places] += (self.weights[code] * weight).sum(axis=1) / norm
            if self.evidence is not None:
                adds[places] += (self.evidence[code] * weight).sum(axis=1) / norm
        return out, adds

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -700, 700)))


class TopWord:
    """Decisions of the words of a text, each distinct normal form decided once."""

    def __init__(self, model: ToxicityModel, limit: int = 500_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        #: Places of words as they stand in texts and of their normal forms, in the two columns of values.
        self.known: dict[str, int] = {}
        self.forms: dict[str, int] = {}
        self.decided, self.adds = np.empty(0), np.empty(0)

    def _learn(self, found: list[str]) -> None:
        forms = [normal(u) for u in found]
        new = list(set(forms).difference(self.forms))
        if new:
            cut = [windows(f) for f in new]
            decided, adds = self.model.decide([w for ws in cut for w in ws])
            starts = cuts(map(len, cut))[:-1]
            self.forms.update(zip(new, range(len(self.decided), len(self.decided) + len(new)), strict=True))
            self.decided = np.concatenate([self.decided, np.maximum.reduceat(decided, starts)])
            self.adds = np.concatenate([self.adds, np.add.reduceat(adds, starts)])
        self.known.update(zip(found, map(self.forms.__getitem__, forms), strict=True))

    def _decision(self, unit: str) -> float:
        return self.decided[self.known[unit]] if unit in self.known else -np.inf

    def tops(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The largest decisions of each text, in falling order and limited to twice the margin, and
        the sum of what its words add beyond the usual, over the root of their number."""
        if len(self.known) > self.limit:
            self._forget()
        read = [units(t) for t in texts]
        new = set(chain.from_iterable(read)).difference(self.known)
        if new:
            self._learn(list(new))
        ends = cuts(map(len, read))
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(read)), int, ends[-1])
        decided, adds = self.decided[places], self.adds[places]
        # Words that a text does not have count as clean ones at the margin.
        least = min(self.model.bias, -1.0)
        top, total = np.full((len(texts), TOPS), least), np.zeros(len(texts))
        for row, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if low < high:
                mine = decided[low:high]
                largest = np.sort(mine if len(mine) <= TOPS else np.partition(mine, -TOPS)[-TOPS:])[::-1]
                top[row, : len(largest)] = largest
                top[row, len(largest) :] = min(largest[-1], least)
                if self.model.evidence is not None:
                    total[row] = (adds[low:high].sum() - self.model.usual * len(mine)) / np.sqrt(len(mine))
        return np.clip(top, -2, 2), total

    def of(self, texts: list[str | None]) -> np.ndarray:
        """The decision of the machine of documents."""
        top, total = self.tops(texts)
        return top @ np.array(self.model.tops) + total

    def words(self, texts: list[str | None]) -> list[str | None]:
        """Of texts just decided: the normal form of the top word, at most one window of it."""
        best = [max(units(t), key=self._decision, default=None) for t in texts]
        return [None if u is None else max(windows(normal(u)), key=self._decision) for u in best]


def _train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 50):
    """Weights and bias with the smallest squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, wa = x[active], weight[active]
        gradient = ridge @ w - (xa * (wa * y[active] * margin[active])[:, None]).sum(axis=0)
        hessian = ridge + (xa * wa[:, None]).T @ xa
        step = np.linalg.solve(hessian + 1e-10 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _landmarks(words: Triples, importance: np.ndarray, n: int) -> list[np.ndarray]:
    """Words far from those already taken, heavy ones first, as dense vectors."""
    near, taken = np.zeros(words.n), []
    while len(taken) < n:
        gain = importance * (1 - near)
        best = int(np.argmax(gain))
        if gain[best] <= 1e-3 * importance.max():
            break
        taken.append(words.dense(best))
        near = np.maximum(near, words.kernel(taken[-1]))
    return taken


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with a hash of their three-word sentence, once for each text."""
    for batch in batches:
        rows = []
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = [normal(u) for u in units(text)]
            around = zip(["", *words], words, [*words[1:], ""], strict=False)
            rows += [(w, xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1, label) for a, w, b in set(around) if 2 < len(w) <= WIDTH]
        yield pd.DataFrame(rows, columns=["word", "sentence", "label"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Texts with a label of 0 or 1, at most ``most`` of them, chosen by the hash of their id."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    # The sample has at most ``most`` pairs of numbers, so the texts stay where they are.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")


def _word_counts(rows: DataFrame) -> DataFrame:
    """Distinct sentences of each word by label. Copies of a document add none; a sentence
    that occurs in both kinds of documents is clean."""
    sentences = rows.mapInPandas(_sentences, "word string, sentence long, label int")
    return (
        sentences.groupBy("word", "sentence")
        .agg(F.min("label").alias("label"))
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )


def _nystroem(triples: Triples, importance: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The map through landmarks of each importance: one column a dimension, over letter triples."""
    marks = [m for each, n in importance for m in _landmarks(triples, each, n)]
    z = np.array(marks)
    values, vectors = np.linalg.eigh(z @ z.T)
    kept = values > 1e-6
    return z.T @ (vectors[:, kept] / np.sqrt(values[kept]))


def _mapped(words: list[str], through: np.ndarray) -> np.ndarray:
    """Maps of words; words without a triple lie at the origin."""
    out = np.zeros((len(words), through.shape[1]), np.float32)
    for low in range(0, len(words), 1000):
        triples = Triples.of(words[low : low + 1000])
        if len(triples.word):
            starts = np.flatnonzero(np.concatenate([[True], triples.word[1:] != triples.word[:-1]]))
            weight, ends = triples.weight.astype(np.float32)[:, None], np.append(starts, len(triples.word))
            for i in range(0, len(starts), MAPPED):
                some = starts[i : i + MAPPED]
                a, b = some[0], ends[i + len(some)]
                maps = through[triples.code[a:b]]
                maps *= weight[a:b]
                out[low + triples.word[some]] = np.add.reduceat(maps, some - a, axis=0)
    return out


def _train(words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[ToxicityModel, np.ndarray]:
    """Landmarks of both kinds, and the machine of words on the map through them."""
    weight = np.where(y > 0, weight * weight[y < 0].sum() / weight[y > 0].sum(), weight)
    triples = Triples.of(words)
    halves = [(np.where(y > 0, weight, 0), LANDMARKS * 2 // 3), (np.where(y < 0, weight, 0), LANDMARKS // 3)]
    through = _nystroem(triples, halves)
    x = np.column_stack([np.bincount(triples.word, c[triples.code] * triples.weight, triples.n) for c in np.ascontiguousarray(through.T)])
    w, bias = _train_machine(x, y, weight)
    return ToxicityModel(through @ w, float(bias), 1.0, 0.0), through


def _documents(rows: DataFrame, model: ToxicityModel, through: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each training document: top decisions, sum of its words' maps, label and number of words."""
    narrow = through.astype(np.float32)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = TopWord(model)
        known: dict[str, int] = {}
        maps = np.zeros((0, narrow.shape[1]), np.float32)
        for whole in batches:
            for low in range(0, len(whole), 100):
                batch = whole.iloc[low : low + 100]
                texts = list(batch["text"])
                tops, _ = top.tops(texts)
                read = [units(t) for t in texts]
                if len(maps) > MAPS or len(known) > 5 * MAPS:
                    known, maps = {}, maps[:0]
                new = {u: normal(u) for u in set(chain.from_iterable(read)).difference(known)}
                cut = {form: windows(form) for form in new.values()}
                if cut:
                    at = cuts(map(len, cut.values()))[:-1]
                    more = np.add.reduceat(_mapped(list(chain.from_iterable(cut.values())), narrow), at, axis=0)
                    rows_of = dict(zip(cut, range(len(maps), len(maps) + len(cut)), strict=True))
                    known.update((u, rows_of[form]) for u, form in new.items())
                    maps = np.concatenate([maps, more])
                total = [maps[np.array([known[u] for u in us], int)].sum(axis=0) for us in read]
                yield pd.DataFrame({"tops": list(tops), "total": total, "label": batch["label"].to_numpy(), "n": list(map(len, read))})

    got = rows.mapInPandas(summed, "tops array<double>, total array<float>, label int, n long").toPandas()
    return np.stack(got["tops"]), np.stack(got["total"]).astype(float), got["label"].to_numpy(), got["n"].to_numpy(float)


def _of_documents(rows: DataFrame, model: ToxicityModel, through: np.ndarray) -> ToxicityModel:
    """``model`` with the machine trained on whole documents."""
    tops, total, label, n = _documents(rows, model, through)
    usual = total.sum(axis=0) / max(1.0, n.sum())
    # A text of usual words lies at the origin, however long it is.
    x = np.column_stack([tops, (total - n[:, None] * usual) / np.sqrt(np.maximum(n, 1))[:, None]])
    spread = x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    y = np.where(label > 0, 1.0, -1.0)
    weight = np.where(label > 0, (label == 0).sum() / max(1, (label > 0).sum()), 1.0)
    w, _ = _train_machine((x - x.mean(axis=0)) / spread, y, weight, DOCUMENT_PENALTY)
    w = w / spread
    slope, offset = _platt(x @ w, label.astype(float))
    return ToxicityModel(model.weights, model.bias, slope, offset, through @ w[TOPS:], tuple(w[:TOPS].tolist()), float(usual @ w[TOPS:]))


def _tops(rows: DataFrame, model: ToxicityModel) -> pd.DataFrame:
    """Decision and top word of each training document: at most ``train_docs`` short rows."""

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = TopWord(model)
        for batch in batches:
            decisions = top.tops(list(batch["text"]))[0][:, 0]
            yield pd.DataFrame({"top": decisions, "word": top.words(list(batch["text"])), "label": batch["label"]})

    return rows.mapInPandas(tops, "top double, word string, label int").toPandas()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Train on at most ``train_docs`` labelled documents; without both classes all scores are equal.

    Words whose sentences are toxic at least eight times as often as others', beyond chance, are the
    positive examples, and the most frequent other words the negative ones, weighted by their
    sentences up to 50. The top words of clean documents are then added as
    negatives and the machine of words is trained again. The machine of documents is then trained on
    all of them; where no word is an example, it sees the map of the most frequent words alone.
    """
    rows = written(labelled(docs, labels, label, train_docs), "training-texts")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(_SYMBOLS**3)
    if not totals.get(0) or not totals.get(1):
        return ToxicityModel(none, 0.0, 0.0, 700.0 if totals.get(1) else -700.0 if totals.get(0) else 0.0)
    counts = written(_word_counts(rows).where("toxic + clean >= 2"), "word-counts")
    both = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    share = (both["t"] or 0) / max(1, (both["t"] or 0) + (both["c"] or 0))
    n = F.col("toxic") + F.col("clean")
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * max(q, 1e-9)))).otherwise(0.0)
    beyond = 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))
    odds = F.col("toxic") * (1 - share) / ((F.col("clean") + 0.5) * max(share, 1e-9))
    signal = (beyond >= 28) & (odds >= 8)
    positive = counts.where(signal).orderBy(F.desc("toxic"), "word").limit(TRAIN_WORDS // 4).collect()
    negative = counts.where(~signal).orderBy(F.desc("clean"), "word").limit(TRAIN_WORDS // 2).collect()
    if not positive or not negative:
        if not positive and not negative:
            return ToxicityModel(none, 0.0, 0.0, float(np.log(totals[1] / totals[0])))
        frequent = [*positive, *negative]
        importance = np.array([r["toxic"] + r["clean"] for r in frequent], float)
        through = _nystroem(Triples.of([r["word"] for r in frequent]), [(importance, LANDMARKS)])
        return _of_documents(rows, ToxicityModel(none, 0.0, 1.0, 0.0), through)
    words = [r["word"] for r in [*positive, *negative]]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.array([min(r["toxic"], 50) for r in positive] + [min(r["clean"], 50) for r in negative], float)
    model, through = _train(words, y, weight)
    for _ in range(ROUNDS):
        seen = _tops(rows, model)
        clean = seen[(seen["label"] == 0) & (seen["top"] > -0.9)].sort_values(["top", "word"], ascending=False)
        hard = list(dict.fromkeys(w for w in clean["word"] if w and w not in set(words)))[: TRAIN_WORDS // 4]
        words += hard
        y = np.concatenate([y, -np.ones(len(hard))])
        weight = np.concatenate([weight, np.full(len(hard), 50.0)])
        model, through = _train(words, y, weight)
    return _of_documents(rows, model, through)


def _platt(decision: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The logistic line through the decisions, with a little weight on small coefficients."""
    x, w = np.column_stack([decision, np.ones(len(decision))]), np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), x.T @ (p - label) + ridge @ w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """Every row with ``score`` and ``predicted``; only the text decides.

    A null, empty or wordless text scores as one of usual clean words. Equal texts score
    equally, repeated rows stay, an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        top = TopWord(sent.value)
        for batch in texts:
            parts = [top.of(list(batch[i : i + 500])) for i in range(0, len(batch), 500)]
            yield pd.Series(sent.value.probability(np.concatenate([*parts, np.empty(0)])))

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score: Column = F.pandas_udf(scores, "double")(F.col("text"))
    scored = docs.withColumn("score", score)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_subsequence_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, with the held-out fold marked."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels").where(remainder("doc_id", 4) != 2))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
