"""Language identification by a linear-chain conditional random field over words.

Every word between white space (lower case, what is no letter stripped at its ends) has hashed features: its prefixes and
suffixes of up to three characters, its character 2- and 3-grams with marks for both ends, and the whole word, which is
a lexicon of the training words. Their weights add up to a score for each language; learned transitions add a score for
each pair of neighbours. Forward-backward gives each word's distribution over the languages, so text that switches
between languages is labelled in stretches. A document's language is the one with the largest mean over its words with
letters; the mean is the score.

Training is on the driver, by full-batch gradient steps on the likelihood. Its sample is about PER_LANGUAGE rows of every
language, chosen by a hash of id and text at the rate that their count over the whole table gives; of a longer text than
SAMPLE_CHARS it takes so many characters, from a place that the hash gives. So the sample has a bounded size for each
language. Words are given their document's language, in sequences of WINDOW words; half of them swap their tails with
another's, so that transitions are learned from switches. The model, at most 2^FEATURE_BITS weights for each language, is
broadcast.

Prediction runs over all words of a text as one chain. It is computed in windows of WINDOW words, many at a time: the
product of a window's steps is a small matrix, these carry the forward and backward weights from window to window, and
then each window is done with the weights that reach it from both sides. Longer words than 16 characters, as lines are in
scripts without spaces, are cut into consecutive words of at most 16, in training too, so all of a text is read.

Defined cases: text that is null or has no letter is "und" with score 0, as is everything if nothing could be learned;
rows are independent, so ties, repeated rows and null ids have no influence (a row without an id is drawn by its text,
and one that is repeated is drawn each time or not at all); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

PER_LANGUAGE, SAMPLE_CHARS, WINDOW, FEATURE_BITS, STEPS = 150, 20_000, 64, 17, 30
WIDE = 16
#: Numbers (windows x words x languages) that are held at once.
AT_ONCE = 1 << 22
NO_LETTERS = re.compile(r"^[\W\d_]+|[\W\d_]+$")
LETTER = re.compile(r"[^\W\d_]")

# ------------------------------------------------------------------------------------------------------------ features


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - FEATURE_BITS)


def words_of(text: str) -> list[str]:
    """The words between white space, those of over WIDE characters in pieces of at most WIDE in lower case."""
    out = []
    for word in text.split():
        if len(word.lower()) <= WIDE:
            out.append(word)
        else:
            size = WIDE if len(word.lower()) == len(word) else WIDE // 2  # one letter's lower case has two characters
            out += [word[k : k + size] for k in range(0, len(word), size)]
    return out


def features(words: list[str]) -> np.ndarray:
    """(words, features) numbers of weights; 0 where a word is too short for a feature, or has no letter."""
    core = [NO_LETTERS.sub("", w) for w in words]
    cut = [w if len(w) <= WIDE else w[:8] + w[-8:] for w in core]
    lengths = np.array([len(w) for w in cut])
    # column 0 and the column after a word hold its marks
    grid = np.zeros((len(words), WIDE + 2), dtype=np.uint64)
    grid[:, 1:-1] = np.array(cut, dtype=f"<U{WIDE}").view(np.uint32).reshape(len(words), WIDE) if words else 0
    grid[:, 0] = 2
    grid[np.arange(len(words)), lengths + 1] = 3
    some = lengths > 0
    columns = []

    def put(kind: int, codes: list[np.ndarray], valid: np.ndarray) -> None:
        x = np.full(len(words), kind, dtype=np.uint64)
        for code in codes:
            x = x * np.uint64(0x100000001B3) + code
        columns.append(np.where(valid & some, _mix(x) | np.uint64(1), 0).astype(np.int32))

    ends = [grid[np.arange(len(words)), np.maximum(lengths - k, 0)] for k in range(3)]
    for n in (1, 2, 3):
        put(n, [grid[:, k + 1] for k in range(n)], lengths >= n)
        put(10 + n, ends[:n], lengths >= n)
    for at in range(WIDE + 1):
        put(20, [grid[:, at], grid[:, at + 1]], lengths + 1 > at)
        if at < WIDE:
            put(21, [grid[:, at], grid[:, at + 1], grid[:, at + 2]], lengths + 1 > at + 1)
    put(30, list(grid.T), some)
    return np.stack(columns, axis=1) if columns else np.zeros((0, 0), dtype=np.int32)


# --------------------------------------------------------------------------------------------------------- the chain


def forward_backward(scores: np.ndarray, mask: np.ndarray, start: np.ndarray, step: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scores: (sequences, length, labels), positive; mask: words that are there, from the left; start and step:
    positive weights, start for all sequences or for each; after: backward weights at the end of sequences whose words are
    all there. The words' distributions, the sum of the pairs', and those of the first words."""
    n, length, labels = scores.shape
    alpha = np.empty_like(scores)
    alpha[:, 0] = scores[:, 0] * start
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * scores[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    gamma = np.empty_like(scores)
    pairs = np.zeros((labels, labels))
    beta = np.ones((n, labels), dtype=scores.dtype) if after is None else after.astype(scores.dtype)
    for t in range(length - 1, -1, -1):
        g = alpha[:, t] * beta
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        if t:
            right = scores[:, t] * beta
            own = mask[:, t]
            weight = (alpha[:, t - 1] * (right @ step.T)).sum(axis=1)
            pairs += step * ((alpha[:, t - 1] * (own / weight)[:, None]).T @ right)
            new = right @ step.T
            beta = np.where(own[:, None], new / new.sum(axis=1, keepdims=True) * labels, 1).astype(scores.dtype)
    return gamma, pairs, gamma[:, 0]


def transfers(scores: np.ndarray, mask: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(sequences, labels, labels): what carries forward weights before a sequence over all its words, up to a factor."""
    n, length, labels = scores.shape
    step = step.astype(np.float64)
    out = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    for t in range(length):
        new = (out.reshape(-1, labels) @ step).reshape(out.shape) * scores[:, t, None, :]
        out = new if mask[:, t].all() else np.where(mask[:, t, None, None], new, out)
        if t % 8 == 7 or t + 1 == length:
            out /= out.max(axis=(1, 2), keepdims=True)
    return out


def chained(scores: np.ndarray, mask: np.ndarray, place: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The distributions of the words of windows: scores and mask as forward_backward() takes them; place: each window's
    number in its text. A text's windows follow each other, and all but its last are full."""
    n, _, labels = scores.shape
    before = np.broadcast_to(start.astype(np.float64), (n, labels)).copy()
    after = np.ones((n, labels))
    last = np.append(place[1:] == 0, True)
    if place.any():
        many = ~((place == 0) & last)
        whole = np.empty((n, labels, labels))
        whole[many] = transfers(scores[many], mask[many], step)
        # a first window's words begin with start, not with a step from what was before
        first = np.flatnonzero((place == 0) & ~last)
        head = start * scores[first, 0].astype(np.float64)
        head /= head.sum(axis=1, keepdims=True)
        rest = transfers(scores[first, 1:], mask[first, 1:], step)
        ends = np.empty((n, labels))
        ends[first] = np.einsum("ni,nij->nj", head, rest)
        ends[first] /= ends[first].sum(axis=1, keepdims=True)
        for k in range(1, int(place.max()) + 1):
            own = np.flatnonzero(place == k)
            before[own] = ends[own - 1] @ step
            ends[own] = np.einsum("ni,nij->nj", ends[own - 1], whole[own])
            ends[own] /= ends[own].sum(axis=1, keepdims=True)
        for k in range(int(place.max()), 0, -1):
            own = np.flatnonzero(place == k)
            x = np.einsum("nij,nj->ni", whole[own], after[own])
            after[own - 1] = x / x.sum(axis=1, keepdims=True) * labels
    return forward_backward(scores, mask, before.astype(scores.dtype), step, after)[0]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels); row 0 is 0
    start: np.ndarray
    step: np.ndarray

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, labels) positive scores, and which words have letters."""
        out, letters = [], []
        for k in range(0, len(words), 4096):
            own = features(words[k : k + 4096])
            x = sum(self.weights[f] for f in own.T)
            out.append(np.exp(np.maximum(x - x.max(axis=1, keepdims=True), -30)))
            letters.append((own != 0).any(axis=1))
        return np.concatenate(out).astype(np.float32), np.concatenate(letters)


def fit(samples: list[tuple[str, str]], seed: int = 1, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """A model of (text, language) samples."""
    labels = sorted({lang for _, lang in samples})
    numbers, rows, tags = defaultdict(count().__next__), [], []
    for text, lang in samples:
        own = [numbers[w] for w in map(str.lower, words_of(text)) if LETTER.search(w)]
        for k in range(0, len(own), WINDOW):
            rows.append(own[k : k + WINDOW])
            tags.append(labels.index(lang))
    k = len(labels)
    if k < 2 or not rows:
        return Model(labels, np.zeros((1 << FEATURE_BITS, max(k, 1)), dtype=np.float32), np.ones(max(k, 1)), np.ones((max(k, 1),) * 2))
    rng = np.random.default_rng(seed)
    ids, truth, mask = (np.zeros((len(rows), WINDOW), dtype=t) for t in (np.int64, np.int64, bool))
    for r, (row, tag) in enumerate(zip(rows, tags, strict=True)):
        ids[r, : len(row)], truth[r], mask[r, : len(row)] = row, tag, True
    order = rng.permutation(len(rows))[: len(rows) // 4 * 2]
    for a, b in zip(order[::2], order[1::2], strict=True):  # half of the sequences swap their tails
        at = rng.integers(4, WINDOW - 4)
        for x in (ids, truth, mask):
            x[a, at:], x[b, at:] = x[b, at:].copy(), x[a, at:].copy()
    gap = ~mask[:, :-1] & mask[:, 1:]
    rest = ~gap.any(axis=1)  # a short sequence can't take a longer one's tail
    ids, truth, mask = ids[rest], truth[rest], mask[rest]
    feats = features(list(numbers))
    size = 1 << FEATURE_BITS
    word, _ = at = np.nonzero(feats)
    flat = feats[at]
    firsts = np.flatnonzero(np.diff(word, prepend=-1))  # of the words that have features: all
    by_feature = np.argsort(flat, kind="stable")
    of_feature = word[by_feature]
    used, starts = np.unique(flat[by_feature], return_index=True)
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs, gold_start = np.zeros((k, k)), np.bincount(truth[mask[:, 0], 0], minlength=k)
    np.add.at(gold_pairs, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    gold = np.stack([np.bincount(ids[mask], truth[mask] == j, len(feats)) for j in range(k)], axis=1)
    params = [np.zeros((size, k)), np.zeros(k), np.zeros((k, k))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    total, rows_at_once = mask.sum(), max(1, AT_ONCE // (WINDOW * k))
    for turn in range(1, STEPS + 1):
        weights, start, step = params
        score = np.stack([np.add.reduceat(np.ascontiguousarray(w)[flat], firsts) for w in weights.T], axis=1)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        by_word, first, pairs = gold.copy(), np.zeros(k), np.zeros((k, k))
        for r in range(0, len(ids), rows_at_once):
            own, there = ids[r : r + rows_at_once], mask[r : r + rows_at_once]
            scores = score[own]
            scores[~there] = 1
            gamma, own_pairs, own_first = forward_backward(scores, there, np.exp(start), np.exp(step))
            pairs += own_pairs
            first += own_first[there[:, 0]].sum(axis=0)
            for j in range(k):
                by_word[:, j] -= np.bincount(own[there], gamma[..., j][there], len(feats))
        grad = np.zeros((size, k))
        for j in range(k):
            grad[used, j] = np.add.reduceat(np.ascontiguousarray(by_word[:, j])[of_feature], starts)
        grads = [grad / total - decay * weights, (gold_start - first) / total, (gold_pairs - pairs) / total]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    weights, start, step = params
    return Model(labels, weights.astype(np.float32), np.exp(start).astype(np.float32), np.exp(step).astype(np.float32))


class Labeller:
    """Distributions of the words of texts; remembers the scores of words."""

    CACHED = 200_000

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.scores = np.empty((1024, len(self.model.labels)), dtype=np.float32)
        self.letters = np.empty(1024, dtype=bool)
        self.known = 0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of all texts: number of the text, distribution, and whether it has letters."""
        if self.known > self.CACHED:
            self._forget()
        number = self.numbers.__getitem__
        ids = [np.array([number(w.lower()) for w in words_of(text)], dtype=np.int64) for text in texts]
        if len(self.numbers) > self.known:
            new = list(self.numbers)[self.known :]
            scores, letters = self.model.emissions(new)
            while len(self.scores) < len(self.numbers):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.empty_like(self.letters)])
            self.scores[self.known : len(self.numbers)], self.letters[self.known : len(self.numbers)] = scores, letters
            self.known = len(self.numbers)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids)
        out = np.empty((len(flat), len(self.model.labels)), dtype=np.float32)
        windows, stops = -(-sizes // WINDOW), np.cumsum(sizes)
        most, first = max(1, AT_ONCE // (WINDOW * len(self.model.labels))), 0
        while first < len(texts):  # as many texts as make most windows, and one at least
            last = max(first + 1, int(np.searchsorted(np.cumsum(windows[first:]), most, side="right")) + first)
            own, a, b = windows[first:last], stops[first] - sizes[first], stops[last - 1]
            if b > a:
                at = np.cumsum(own) - own  # the first window of each text
                place = np.arange(b - a) - np.repeat(stops[first:last] - sizes[first:last] - a, sizes[first:last]) + WINDOW * np.repeat(at, sizes[first:last])
                grid = np.full(WINDOW * own.sum(), -1, dtype=np.int64)
                grid[place] = flat[a:b]
                grid = grid.reshape(-1, WINDOW)
                mask = grid >= 0
                scores = self.scores[grid]
                scores[~mask] = 1
                found = chained(scores, mask, np.arange(len(grid)) - np.repeat(at, own), self.model.start, self.model.step)
                out[a:b] = found.reshape(-1, out.shape[1])[place]
            first = last
        return np.repeat(np.arange(len(texts)), sizes), out, self.letters[flat]

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        text, p, letters = self.words(texts)
        labels = self.model.labels
        sums = np.stack([np.bincount(text[letters], p[letters, j], len(texts)) for j in range(len(labels))], axis=1)
        n = np.bincount(text[letters], minlength=len(texts))
        best = sums.argmax(axis=1)
        means = sums[np.arange(len(texts)), best] / np.maximum(n, 1)
        return [(labels[b], min(1.0, float(s))) if k else ("und", 0.0) for b, s, k in zip(best, means, n, strict=True)]


# ----------------------------------------------------------------------------------------------------------- operators


def train(docs: DataFrame, eligible: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of a bounded sample of the eligible rows that have a language and a text."""
    rows = docs.filter(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    draw = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1 << 40))
    spare = F.length("text") - SAMPLE_CHARS
    piece = F.when(spare > 0, F.substring("text", F.pmod(F.xxhash64("id", "text", F.lit(18)), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    below = docs.sparkSession.createDataFrame([(r.lang, min(1 << 40, (per_language << 40) // r["count"])) for r in counts], "lang string, below long")
    sample = rows.join(F.broadcast(below), "lang").filter(draw < F.col("below")).select("id", piece.alias("text"), "lang").limit(2 * per_language * len(counts))
    return fit([(r.text, r.lang) for r in sorted(sample.collect(), key=lambda r: (str(r.id), r.text, r.lang))])


_LABELLERS: dict[int, Labeller] = {}


def _labeller(sent) -> Labeller:
    """One for each broadcast model and worker process."""
    if sent.id not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[sent.id] = Labeller(sent.value[1])
    return _LABELLERS[sent.id]


class _Sent:
    """A broadcast model with a name of its own."""

    def __init__(self, spark, model: Model):
        import uuid

        self.id = uuid.uuid4().hex
        self.cast = spark.sparkContext.broadcast((self.id, model))

    @property
    def value(self):
        return self.cast.value


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Columns of docs of these names are replaced."""
    kept = [(n, t) for n, t in docs.dtypes if n not in ("lang_pred", "score")]
    names = [n for n, _ in kept]
    sent = _Sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 1024):
            texts = common.texts(batch.column(names.index(text_col)))
            found = _labeller(sent).documents(texts) if model.labels else [("und", 0.0)] * len(texts)
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept), "lang_pred string, score double"])
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, words): for each text the array of (word, lang, score) of its words, with their own languages (pieces of long words are words)."""
    sent = _Sent(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 256):
            texts = common.texts(batch.column(1))
            out = [[] for _ in texts]
            if model.labels:
                text, p, letters = _labeller(sent).words(texts)
                words = [w for t in texts for w in words_of(t)]
                for t, w, row, has in zip(text, words, p, letters, strict=True):
                    best = int(row.argmax())
                    out[t].append({"word": w, "lang": model.labels[best] if has else "und", "score": float(row[best]) if has else 0.0})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[id_col, "words"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, words array<struct<word: string, lang: string, score: double>>")


def held_out(id_col: str = "doc_id") -> Column:
    """The remainder of the id's CRC by 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out())
    found = predict(common.spread(docs.select("doc_id", "text")), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
