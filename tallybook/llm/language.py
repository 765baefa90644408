"""Language identification by a linear-chain conditional random field over the words of a text.

Words are labelled with languages, so that code-switched text gets the language of each of its parts. A word's features
are its prefixes and suffixes of one to three letters, its letter trigrams (ends marked), and the word itself if
the lexicon of the training words has it. Weights of features and of transitions between labels are learned
together, by the gradient of the conditional likelihood. A document's probability of a language is the mean
over its words of the posteriors that forward-backward gives.

Training takes a bounded sample: of each language the ``DOCUMENTS_EACH`` documents with the smallest hash, of each up to
``WORDS_EACH`` words. Spans from documents of different languages are put behind one another, so that
switches are seen too. Prediction reads whole texts, in chains of ``CHAIN`` words.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import release, ship

DOCUMENTS_EACH = 120
WORDS_EACH = 250
# A training text is read up to here; that is part of the sample's bound.
SAMPLE_CHARS = 20_000
CHAIN = 64
SPAN = (6, 30)
STEPS = 40
KNOWN = 150_000
UNKNOWN = "und"
SHARE_HELD_OUT = 5

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    marked = f"^{word}$"
    found = ["=" + word]
    found += ["<" + word[:n] for n in (1, 2, 3)] + [">" + word[-n:] for n in (1, 2, 3)]
    return found + [marked[i : i + 3] for i in range(len(marked) - 2)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forward_backward(emission: np.ndarray, transition: np.ndarray, valid: np.ndarray):
    """Posteriors (chains, words, labels), expected transitions (labels, labels) and log-likelihood norms.

    ``emission`` and ``transition`` are scores; ``valid`` marks the words of each chain, which come first.
    """
    top = emission.max(axis=2, keepdims=True)
    e, a = np.exp(emission - top), np.exp(transition)
    chains, length, labels = e.shape
    forward, scale = np.empty_like(e), np.ones((chains, length), e.dtype)
    state = e[:, 0]
    for t in range(length):
        if t:
            state = (forward[:, t - 1] @ a) * e[:, t]
        scale[:, t] = np.maximum(state.sum(axis=1), 1e-30)
        forward[:, t] = state / scale[:, t, None]
    backward = np.ones_like(e)
    for t in range(length - 2, -1, -1):
        back = (e[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]) @ a.T
        backward[:, t] = np.where(valid[:, t + 1, None], back, 1.0)
    posterior = forward * backward
    posterior /= np.maximum(posterior.sum(axis=2, keepdims=True), 1e-30)
    posterior *= valid[..., None]
    pairs = np.zeros((labels, labels))
    ahead = e * backward / scale[..., None] * valid[..., None]
    for t in range(length - 1):
        pairs += forward[:, t].T @ ahead[:, t + 1]
    norm = float(((np.log(scale) + top[..., 0]) * valid).sum())
    return posterior, pairs * a, norm


class Model:
    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.index, self.weights, self.transition = labels, index, weights, transition
        self.forget()

    def __getstate__(self):
        return self.labels, self.index, self.weights, self.transition

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 16, len(self.labels)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Make ``rows`` and ``scores`` hold these words."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > KNOWN:
            self.forget()
            new = list(words)
        if not new:
            return
        get, flat, ends = self.index.get, [], []
        for word in new:
            flat += [i for i in map(get, features(word)) if i is not None]
            ends.append(len(flat))
        sums = np.zeros((len(flat) + 1, len(self.labels)))
        np.cumsum(self.weights[flat], axis=0, out=sums[1:])
        bounds = np.array([0, *ends])
        at = len(self.rows)
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at : at + len(new)] = sums[bounds[1:]] - sums[bounds[:-1]]
        self.rows.update(zip(new, range(at, at + len(new))))

    def shares(self, texts: list[str]) -> np.ndarray:
        """Mean posterior of each label over the words of each text; zeros for a text without words."""
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split))
        out = np.zeros((len(texts), len(self.labels)))
        counts = np.array([len(w) for w in split])
        get = self.rows.__getitem__
        flat = np.fromiter((get(w) for words in split for w in words), np.int64, counts.sum())
        if not len(flat):
            return out
        at, owner, _ = _chains(counts)
        ends = np.cumsum(counts)
        place = at[:, None] + np.arange(CHAIN)
        valid = place < ends[owner][:, None]
        for lo in range(0, len(at), 4096):
            some, ok = place[lo : lo + 4096], valid[lo : lo + 4096]
            emission = self.scores[flat[np.where(ok, some, at[lo : lo + 4096, None])]]
            posterior, _, _ = forward_backward(emission, self.transition.astype(np.float32), ok)
            np.add.at(out, owner[lo : lo + 4096], posterior.sum(axis=1))
        return out / np.maximum(counts, 1)[:, None]


def _chains(counts: np.ndarray):
    """Start and owner of each chain when texts of so many words lie behind one another."""
    per = -(-counts // CHAIN)
    owner = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(counts) - counts)[owner] + nth * CHAIN, owner, nth


def train(sample: list[tuple[str, str]]) -> Model | None:
    """A model from (language, text) pairs; None if there is no word to learn from."""
    labels = sorted({lang for lang, _ in sample})
    spans = _spans([(labels.index(lang), words_of(text)[:WORDS_EACH]) for lang, text in sample])
    words = [w for w, _ in spans]
    if not words:
        return None
    label = np.array([y for _, y in spans])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    index: dict[str, int] = {}
    nonzero_word, nonzero_feature = [], []
    for word, i in vocabulary.items():
        for f in features(word):
            nonzero_word.append(i)
            nonzero_feature.append(index.setdefault(f, len(index)))
    rows, cols = np.array(nonzero_word), np.array(nonzero_feature)
    n, k, size = len(words), len(labels), len(index)
    ids = np.array([vocabulary[w] for w in words])
    pad = -n % CHAIN
    chains = np.concatenate([ids, np.zeros(pad, int)]).reshape(-1, CHAIN)
    valid = (np.arange(n + pad) < n).reshape(-1, CHAIN)
    gold = np.concatenate([label, np.zeros(pad, int)]).reshape(-1, CHAIN)
    truth = np.eye(k)[gold] * valid[..., None]
    both = valid[:, 1:] & valid[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)

    weights, transition = np.zeros((size, k)), np.zeros((k, k))
    # Adam; the gradient is what is expected less what is seen, with a pull to zero.
    mean, spread = [np.zeros_like(weights), np.zeros_like(transition)], [np.zeros_like(weights), np.zeros_like(transition)]
    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(rows, weights[cols, j], len(vocabulary)) for j in range(k)], axis=1)
        posterior, pairs, _ = forward_backward(scores[chains], transition, valid)
        rest = (posterior - truth).reshape(-1, k)
        by_word = np.stack([np.bincount(chains.ravel(), rest[:, j], len(vocabulary)) for j in range(k)], axis=1)
        slope = [
            np.stack([np.bincount(cols, by_word[rows, j], size) for j in range(k)], axis=1) / n + 1e-6 * weights,
            (pairs - seen) / n + 1e-6 * transition,
        ]
        for i, (value, rate) in enumerate(((weights, 0.1), (transition, 0.05))):
            mean[i] = 0.9 * mean[i] + 0.1 * slope[i]
            spread[i] = 0.99 * spread[i] + 0.01 * slope[i] ** 2
            value -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, weights.astype(np.float32), transition)


def _spans(sample: list[tuple[int, list[str]]]) -> list[tuple[str, int]]:
    """Words with labels: spans of the documents, dealt in an order that mixes languages."""
    spans = []
    for d, (label, words) in enumerate(sample):
        at, turn = 0, 0
        while at < len(words):
            key = zlib.crc32(f"{d}-{turn}".encode())
            length = SPAN[0] + key % (SPAN[1] - SPAN[0])
            spans.append((key, d, label, words[at : at + length]))
            at, turn = at + length, turn + 1
    spans.sort(key=lambda s: s[:2])
    return [(w, label) for _, _, label, words in spans for w in words]


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(SHARE_HELD_OUT))


def sample_of(docs: DataFrame) -> list[tuple[str, str]]:
    """At most ``DOCUMENTS_EACH`` texts of each language, none of the held-out fifth."""
    usable = docs.filter((remainder() != 0) & F.col("lang").isNotNull()).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= DOCUMENTS_EACH)
    # Bounded: DOCUMENTS_EACH rows for each language.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    found = texts.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return [(r.lang, r.text) for r in sorted(found.select("lang", "doc_id", "text").collect())]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang, any other columns).

    Learns from the rows with a language whose crc32(doc_id as text) is not divisible by 5. ``und`` with score 0 where the
    text is null or has no letter, or where nothing could be learned. A null doc_id counts as held out. An empty table gives no rows.
    """
    return predicted(docs, train(sample_of(docs))).drop("text")


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score by a trained model."""
    held = F.coalesce(remainder() == 0, F.lit(True)).alias("held_out")
    labelled = docs.select("doc_id", held, "text")
    if model is None:
        return labelled.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        model = shared.value
        for texts in columns:
            parts = [_labelled(model, texts.iloc[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    both = F.pandas_udf(run, "lang_pred string, score double")
    found = labelled.withColumn("_found", both("text"))
    return found.select("doc_id", "text", "held_out", "_found.lang_pred", "_found.score")


def _labelled(model: Model, texts: pd.Series) -> pd.DataFrame:
    shares = model.shares([t or "" for t in texts])
    best = shares.argmax(axis=1)
    score = np.clip(shares[np.arange(len(best)), best], 0, 1)
    # Superscripts and the like form words without a letter.
    score[[not any(map(str.isalpha, t or "")) for t in texts]] = 0
    names = np.array([*model.labels, UNKNOWN], object)
    return pd.DataFrame({"lang_pred": names[np.where(score > 0, best, len(model.labels))], "score": score})


# Texts are kept from this mean posterior on: below, no language holds even two fifths of the words.
LEAST_SCORE = 0.4


def in_a_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language; all its columns.

    Where no row has a language to learn from, nothing can be told of any text, and all rows stay.
    """
    model = train(sample_of(docs))
    if model is None:
        return docs
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        model = shared.value
        for texts in columns:
            parts = [_labelled(model, texts.iloc[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pd.concat(parts)["score"] if parts else pd.Series([], dtype=float)

    score = F.pandas_udf(run, "double")
    return docs.filter(score("text") >= least)
