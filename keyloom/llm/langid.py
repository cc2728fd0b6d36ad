"""Language identification by a linear-chain conditional random field over words.

Each word (the letters of a white-space token, lower-cased) gets a score for each language from hashed
features: its character n-grams of 1 to 4 with word ends marked (so prefixes and suffixes are among them) and
whether a lexicon of frequent training words has it. Learned transitions link neighbouring words; they are learned from
the training documents and from code-switched sequences spliced out of them. The marginals of forward-backward label
every word, in code-switched text too; a document's language is the one with the largest mean marginal, which is its
score. Texts of more than 4096 words are labelled in runs of so many, each with 64 words of its neighbours on both
sides, whose influence fades with every word.

Edge cases: a null text, or one without letters, is `und` with score 0. Documents without a lang or a text
teach nothing; with no labelled document at all everything is `und`. Null doc_ids are not held out. Equal
texts get equal predictions. Texts of any length are labelled whole. The 256 most frequent langs are learned (the model
has a weight for each). Repeated rows are kept. Other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, give_back, released, slices

_SLOTS = 1 << 17
_WINDOW = 128
_MOST_WORDS = 250_000
_RUN, _REACH = 4096, 64
_SLICE = 2 << 20  # forward-backward takes some ten bytes for each of text
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    transitions: np.ndarray  # languages x languages, logarithms
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray  # entries x languages
    _codes: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_codes": {}, "_scores": None}

    def forget(self) -> None:
        """Drops the table of words: a worker between tasks holds none."""
        self._codes, self._scores = {}, None

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words with letters, and each text's count of them. _scores has a row for each code."""
        if self._scores is None or len(self._codes) > _MOST_WORDS:
            self._codes, self._scores = {}, np.zeros((0, len(self.languages)), np.float32)
        known, new, all_codes, counts = self._codes, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            tokens = text.split()
            try:
                found = [known[t] for t in tokens]
            except KeyError:
                found = []
                for t in tokens:
                    code = known.get(t)
                    if code is None:
                        word = (t if t.isalpha() else "".join(filter(str.isalpha, t))).lower()
                        code = -1
                        if word:
                            code = len(self._scores) + len(new)
                            new.append(word)
                        known[t] = code
                    found.append(code)
            own = np.array(found, np.int64)
            own = own[own >= 0]
            counts[i] = len(own)
            all_codes.append(own)
        if new:
            slots, starts = features(new)
            scores = np.add.reduceat(self.weights[slots], starts, axis=0)
            entries = [self.lexicon.get(w, -1) for w in new]
            at = np.array(entries)
            scores[at >= 0] += self.lexicon_weights[at[at >= 0]]
            self._scores = np.concatenate([self._scores, scores.astype(np.float32)])
        return (np.concatenate(all_codes) if all_codes else np.zeros(0, np.int64)), counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        codes, counts = self.codes(texts)
        marginals = in_runs(self._scores[codes], counts, self.transitions)
        full = np.flatnonzero(counts)
        if len(full):
            sums = np.add.reduceat(marginals.astype(np.float64), (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
            for i, k in zip(full.tolist(), sums.argmax(axis=1).tolist(), strict=True):
                names[i] = self.languages[k]
            scores[full] = np.clip(sums.max(axis=1), 0, 1)
        return names, scores


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words, and where each word's begin."""
    text = "".join(f"^{w}$" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    slots, valid = [], []
    gram = np.zeros(len(chars), np.uint64)
    for n in range(1, 5):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[: len(chars) - n + 1] = chars[n - 1 :]
        gram = (gram + shifted + np.uint64(1)) * _PRIME
        gram ^= gram >> np.uint64(29)
        slots.append(gram >> np.uint64(47))
        valid.append(at + n <= ends)
    grid, keep = np.column_stack(slots).ravel(), np.column_stack(valid).ravel()
    per_word = np.add.reduceat(keep, (np.cumsum(lengths) - lengths) * 4)
    return grid[keep].astype(np.int64), np.cumsum(per_word) - per_word


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of all words of the sequences (counts: their lengths, 0 allowed), and with `pairs` the expected
    number of each transition. All sequences move a word at a time, the longest first."""
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    move = np.exp(transitions - transitions.max()).astype(emit.dtype)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    alpha, expected = np.empty_like(emit), np.zeros((k, k))
    state = None
    for t in range(steps):
        n = active[t]
        at = starts[:n] + t
        state = emit[at] if t == 0 else (state[:n] @ move) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    out = np.empty_like(emit)
    beta = np.ones((len(lengths), k), emit.dtype)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        post = alpha[at] * beta[:n]
        out[at] = post / post.sum(axis=1, keepdims=True)
        if t:
            back = emit[at] * beta[:n]
            if pairs:
                joint = alpha[at - 1][:, :, None] * move[None] * back[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = back @ move.T
            beta[:n] = back / back.sum(axis=1, keepdims=True)
    return out, expected if pairs else None


def in_runs(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, run: int = _RUN, reach: int = _REACH) -> np.ndarray:
    """The marginals of all words, longer sequences in overlapping runs: a text's steps don't grow with its length."""
    if not (counts > run).any():
        return forward_backward(scores, counts, transitions)[0]
    at, sizes, keep = [], [], []
    for first, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
        for begin in range(0, n, run):
            lo, hi = max(0, begin - reach), min(n, begin + run + reach)
            at.append(np.arange(first + lo, first + hi))
            sizes.append(hi - lo)
            own = np.arange(lo, hi)
            keep.append((own >= begin) & (own < begin + run))
    return forward_backward(scores[np.concatenate(at)], np.array(sizes), transitions)[0][np.concatenate(keep)]


def spliced(sequences: list[tuple[list[int], int]], share: float = 0.25, seed: int = 3) -> list[tuple[list[int], list[int]]]:
    """Code-switched sequences of (codes, labels): runs of 4 to 24 words out of (codes, language) sequences of two
    languages by turns, a share of the sequences in number."""
    rng = np.random.default_rng(seed)
    by_language: dict[int, list[list[int]]] = {}
    for codes, label in sequences:
        by_language.setdefault(label, []).append(codes)
    languages = sorted(by_language)
    out = []
    for _ in range(int(share * len(sequences)) if len(languages) > 1 else 0):
        two = rng.choice(len(languages), 2, replace=False)
        words, labels, turn = [], [], 0
        while len(words) < _WINDOW:
            label = languages[two[turn]]
            source = by_language[label][int(rng.integers(len(by_language[label])))]
            begin, n = int(rng.integers(len(source))), int(rng.integers(4, 25))
            words += source[begin : begin + n]
            labels += [label] * len(source[begin : begin + n])
            turn = 1 - turn
        out.append((words[:_WINDOW], labels[:_WINDOW]))
    return out


def fit(rows: list[tuple[str, str]], rounds: int = 25, rate: float = 0.12, ridge: float = 1e-6, seen: int = 4) -> Crf:
    """Fits the field to (text, language) rows: every word bears its document's language, in spliced sequences too.
    Deterministic."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    index: dict[str, int] = {}
    sequences: list[tuple[list[int], int]] = []
    for text, lang in rows:
        tokens = ["".join(filter(str.isalpha, t)).lower() for t in text.split()]
        codes = [index.setdefault(w, len(index)) for w in tokens if w]
        for i in range(0, len(codes), _WINDOW):
            sequences.append((codes[i : i + _WINDOW], languages.index(lang)))
    words, labels, counts = [], [], []
    for part, marks in [*((c, [lang] * len(c)) for c, lang in sequences), *spliced(sequences)]:
        words += part
        labels += marks
        counts.append(len(part))
    word, label, count = np.array(words, np.int64), np.array(labels, np.int64), np.array(counts, np.int64)
    vocabulary = list(index)
    if not len(word):
        return Crf(languages, np.zeros((_SLOTS, k), np.float32), np.zeros((k, k)), {}, np.zeros((0, k), np.float32))
    slots, starts = features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(starts, len(slots))))
    frequent = np.flatnonzero(np.bincount(word, minlength=len(vocabulary)) >= seen)
    weights, lexical, transitions = np.zeros((_SLOTS, k)), np.zeros((len(vocabulary), k)), np.zeros((k, k))
    in_lexicon = np.zeros(len(vocabulary), bool)
    in_lexicon[frequent] = True
    truth = np.zeros((len(word), k))
    truth[np.arange(len(word)), label] = 1
    inside = np.ones(len(word), bool)
    inside[np.cumsum(count) - count] = False
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (label[:-1][inside[1:]], label[1:][inside[1:]]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, lexical, transitions)]
    total = len(word)
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(weights[slots], starts, axis=0) + np.where(in_lexicon[:, None], lexical, 0)
        marginals, expected = forward_backward(scores[word], count, transitions, pairs=True)
        wrong = marginals - truth
        by_word = np.column_stack([np.bincount(word, wrong[:, j], len(vocabulary)) for j in range(k)])
        by_slot = np.column_stack([np.bincount(slots, by_word[owner, j], _SLOTS) for j in range(k)])
        grads = (by_slot / total + ridge * weights, np.where(in_lexicon[:, None], by_word, 0) / total, (expected - true_pairs) / total + 1e-3 * transitions)
        for p, g, m in zip((weights, lexical, transitions), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Crf(languages, weights.astype(np.float32), transitions, {vocabulary[i]: n for n, i in enumerate(frequent.tolist())}, lexical[frequent].astype(np.float32))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 100, most_languages: int = 256) -> Crf:
    """Fits on about `per_language` whole documents of each lang, drawn by a hash of doc_id and text from those
    that are not held out, for the most_languages most frequent langs. These bounds hold at every size of the corpus."""
    labelled = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l"))
    labelled = labelled.filter(~held_out(F.col("d")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    draw = F.pmod(F.xxhash64("d", "t"), F.lit(1 << 30)) / float(1 << 30)
    labelled = labelled.withColumn("draw", draw)
    found = labelled.groupBy("l").agg(F.count("*").alias("n"), F.min("draw").alias("least")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    if not found:
        return fit([])
    # Each language has its first draw at least. A row that is repeated counts once, so repeats can't swell the sample.
    share = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.l, max(per_language / r.n, r.least))]), F.col("l"))
    return fit(sorted({(r.t, r.l) for r in labelled.filter(F.col("draw") <= share).select("t", "l").distinct().collect()}))


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """docs with lang_pred and score. Only the texts go to Python: the rows wait in the JVM, which can spill them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by slots, languages and sample

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], []
            for part in slices([pa.record_batch([batch], names=["text"])], "text", _SLICE):
                n, s = shared.value.predict(part.column("text").to_pylist())
                names += n
                scores += s.tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        shared.value.forget()
        give_back()

    predict = F.arrow_udf(run, "lang_pred string, score double")
    rows = carried(docs, found=predict(F.col("text").cast("string")))
    return released(rows, docs.columns, lang_pred=F.col("found.lang_pred"), score=F.col("found.score"))


def identify_keys(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the same without carrying texts back to the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])
        shared.value.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    few = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Crf, least: float = 0.3) -> DataFrame:
    """The documents whose language is known: not `und`, and with a mean marginal of at least `least`
    (code-switched text of two or three languages stays). Columns as in docs."""
    rows = carried(docs, text=F.col("text").cast("string"))
    out = identify(rows, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
