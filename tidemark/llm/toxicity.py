"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

Inputs. Each word has a word input (how much more often documents with the label hold it) and character inputs (the same for
its 3- to 6-byte pieces, with the word's ends marked), so that unseen words built from telling pieces are recognised. Counts are
over hashed features of a bounded sample of labelled rows. A document trains on counts made without its own fold.

Network. Gates use the softsign function, which costs a division instead of an exponential. Each direction is a gated recurrent
layer; attention weights pool the states of a window, and a window has one logit. All windows of a text are scored: ``window``
words, a new one every ``stride`` words, so that neighbours overlap. Training picks the window of a document with the highest
logit so far (and a second one by turns). A logistic regression over the highest logit, the mean probability and the number of
windows gives the document's score, with the label's true share as prior. Everything is trained with numpy on the driver.

Bounds. ``sample`` rows of either label, of at most ``sample_chars`` characters, are drawn by hash. That is the only bound: every
whole text is scored. Words are cached per task up to ``vocabulary`` entries; a full cache is emptied.

Defined cases. A null, empty or blank text has one window without words and gets the network's bias. Labels that are null are
no labels; a document with several labels has the highest. Without both labels there is nothing to learn and every score is the
label's (smoothed) share. Rows are scored one by one, so repeated rows, null ids and ties need no rule. Only ``doc_id`` and
``text`` are read by ``score``; ``keep_clean`` returns all columns untouched, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, map_batches, raw_texts

BITS = 18
SIZES = (3, 4, 5, 6)
FEATURES = 8
SLICE = 20_000  # words whose pieces are hashed at once
# lower-case A-Z; punctuation and control characters separate words
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() or c == 39 else 32) for c in range(256)
)


@dataclass(frozen=True)
class Settings:
    window: int = 48
    stride: int = 32
    hidden: int = 8
    sample: int = 1500
    sample_chars: int = 20_000
    folds: int = 5
    epochs: int = 6
    rate: float = 0.01
    batch: int = 128
    seed: int = 7
    vocabulary: int = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _pieces(words: list[bytes]):
    """Hashed pieces of each size at every byte of ``b' ' + b' '.join(words) + b' '``, and where each word starts.

    The blank before a word is its first byte, the blank after it may end a piece. Invalid pieces are -1.
    """
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(length[:-1] + 1)))
    end = np.repeat(starts + length + 2, length + 1)  # one after the closing blank, for each byte but the last
    at = np.arange(len(end))
    key = np.zeros(len(end), np.uint64)
    wide = np.concatenate((text, np.zeros(max(SIZES), np.uint8))).astype(np.uint64)
    out = []
    for n in range(1, max(SIZES) + 1):
        key = key * np.uint64(0x100000001B3) + wide[n - 1 : n - 1 + len(end)] + np.uint64(1)
        if n in SIZES:
            mixed = ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            out.append(np.where(at + n <= end, mixed.astype(np.int32), np.int32(-1)))
    return out, starts


def _all_pieces(words: list[bytes]):
    """(sizes, bytes) hashed pieces of a whole vocabulary, with the first byte of each word and the end."""
    parts, starts, base = [], [], 0
    for i in range(0, len(words), SLICE):
        keys, at = _pieces(words[i : i + SLICE])
        parts.append(np.stack(keys))
        starts.append(at + base)
        base += len(keys[0])
    return (np.concatenate(parts, 1), np.concatenate([*starts, [base]])) if parts else (np.zeros((len(SIZES), 0), np.int32), np.zeros(1, np.int64))


def _word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) & ((1 << BITS) - 1)


def word_features(words: list[bytes], word_table: np.ndarray, piece_table: np.ndarray) -> np.ndarray:
    """(words, FEATURES) inputs from the weights of words and pieces."""
    if len(words) > SLICE:
        return np.concatenate([word_features(words[i : i + SLICE], word_table, piece_table) for i in range(0, len(words), SLICE)])
    out = np.zeros((len(words), FEATURES), np.float32)
    if not words:
        return out
    out[:, 0] = word_table[_word_keys(words)]
    pieces, starts = _pieces(words)
    for k, keys in enumerate(pieces):
        value = np.where(keys >= 0, piece_table[keys], 0)
        out[:, 1 + k] = np.maximum.reduceat(value, starts)
        if k == 1:
            out[:, 5] = np.add.reduceat(value, starts) / np.maximum(1, np.add.reduceat((keys >= 0).astype(np.float32), starts))
            out[:, 6] = np.minimum.reduceat(value, starts)
    out[:, 7] = np.log1p(np.fromiter(map(len, words), np.float32, len(words))) - 1.5
    return out


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of each feature over its standard error: 0 up to 1.5 errors, softly bounded above."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.tanh(np.sign(z) * np.maximum(np.abs(z) - 1.5, 0) / 2).astype(np.float32)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Model:
    settings: Settings
    word_table: np.ndarray
    piece_table: np.ndarray
    net: dict[str, np.ndarray]
    final: np.ndarray
    prior: float


def _init(settings: Settings) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(settings.seed), settings.hidden
    net = {}
    for d in "fb":
        net["W" + d] = (rng.standard_normal((FEATURES, 3 * h)) * 0.5).astype(np.float32)
        net["U" + d] = (rng.standard_normal((h, 3 * h)) * 0.3).astype(np.float32)
        net["c" + d] = np.zeros(3 * h, np.float32)
        net["o" + d] = (rng.standard_normal((h, 2)) * 0.5).astype(np.float32)  # attention score, value
    net["bias"] = np.zeros(1, np.float32)
    return net


def _run(inputs: np.ndarray, ids: np.ndarray, real: np.ndarray, net: dict, d: str, keep: list | None = None) -> np.ndarray:
    """(steps, windows, 2) attention scores and values of one direction; ``inputs`` are the projected words."""
    h_size = net["U" + d].shape[0]
    h = np.zeros((ids.shape[0], h_size), np.float32)
    out = np.empty((ids.shape[1], ids.shape[0], 2), np.float32)
    steps = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
    for t in steps:
        a, g = inputs[ids[:, t]], h @ net["U" + d]
        gates = _soft(a[:, : 2 * h_size] + g[:, : 2 * h_size]) * 0.5 + 0.5
        z, r = gates[:, :h_size] * real[:, t : t + 1], gates[:, h_size:]
        c = _soft(a[:, 2 * h_size :] + r * g[:, 2 * h_size :])
        if keep is not None:
            keep.append((t, h, g, gates, c))
        h = h + z * (c - h)
        out[t] = h @ net["o" + d]
    return out


def _pool(out: np.ndarray, real: np.ndarray, bias: float):
    """Logits, attention weights and values."""
    score = np.where(real.T > 0, out[:, :, 0], -1e9)
    weight = np.exp(score - score.max(0)) * (real.T > 0)
    weight /= np.maximum(weight.sum(0), 1e-9)
    return (weight * out[:, :, 1]).sum(0) + bias, weight, out[:, :, 1]


def project(features: np.ndarray, net: dict) -> dict[str, np.ndarray]:
    """What words add to the gates of each direction."""
    return {d: features @ net["W" + d] + net["c" + d] for d in "fb"}


def window_logits(projected: dict[str, np.ndarray], ids: np.ndarray, real: np.ndarray, net: dict, block: int = 2048) -> np.ndarray:
    """A logit for every window; ``projected`` are the words that ``ids`` point at."""
    found = np.empty(len(ids), np.float32)
    for i in range(0, len(ids), block):
        part, mask = ids[i : i + block], real[i : i + block]
        out = _run(projected["f"], part, mask, net, "f") + _run(projected["b"], part, mask, net, "b")
        found[i : i + block] = _pool(out, mask, net["bias"][0])[0]
    return found


def _gradients(features, ids, real, target, weight_of, net):
    """Gradients of the weighted logistic loss."""
    kept: dict[str, list] = {"f": [], "b": []}
    outs = {}
    # only the words of these windows
    words, local = np.unique(ids, return_inverse=True)
    projected = project(features[words], net)
    for d in "fb":
        outs[d] = _run(projected[d], local.reshape(ids.shape), real, net, d, kept[d])
    logit, attention, value = _pool(outs["f"] + outs["b"], real, net["bias"][0])
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    d_logit = ((p - target) * weight_of / weight_of.sum()).astype(np.float32)
    pooled = (attention * value).sum(0)
    d_out = np.stack((attention * (value - pooled) * d_logit, attention * d_logit), 2).astype(np.float32)
    grads = {"bias": np.array([d_logit.sum()], np.float32)}
    for d in "fb":
        n = net["U" + d].shape[0]
        g_w, g_u, g_o = np.zeros_like(net["W" + d]), np.zeros_like(net["U" + d]), np.zeros_like(net["o" + d])
        g_c, back = np.zeros(3 * n, np.float32), np.zeros((len(ids), n), np.float32)
        for t, h, g, gates, c in reversed(kept[d]):
            m = real[:, t : t + 1]
            z, r = gates[:, :n] * m, gates[:, n:]
            now = h + z * (c - h)
            g_o += now.T @ d_out[t]
            d_h = back + d_out[t] @ net["o" + d].T
            d_c = z * d_h * (1 - np.abs(c)) ** 2
            slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            d_z = m * d_h * (c - h) * slope[:, :n]
            d_r = d_c * g[:, 2 * n :] * slope[:, n:]
            d_g = np.concatenate((d_z, d_r, d_c * r), 1)
            d_a = np.concatenate((d_z, d_r, d_c), 1)
            g_u += h.T @ d_g
            g_w += features[ids[:, t]].T @ d_a
            g_c += d_a.sum(0)
            back = d_h * (1 - z) + d_g @ net["U" + d].T
        grads |= {"W" + d: g_w, "U" + d: g_u, "c" + d: g_c, "o" + d: g_o}
    return grads


def cut_windows(counts: np.ndarray, settings: Settings):
    """(document of each window, first word, words) of all windows, given the words of each document.

    The last window is the first one that reaches the end of the text.
    """
    n = np.maximum(0, -(-(counts - settings.window) // settings.stride)) + 1
    doc = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = step * settings.stride
    return doc, first, np.clip(counts[doc] - first, 0, settings.window)


def _gather(ids: np.ndarray, starts: np.ndarray, doc, first, size, settings: Settings):
    """Window matrices of word numbers (0 where there is none) and their mask."""
    at = np.arange(settings.window)
    real = at[None, :] < size[:, None]
    place = np.where(real, (starts[doc] + first)[:, None] + at[None, :], 0)
    found = ids[place] if len(ids) else np.zeros(place.shape, np.int64)
    return np.where(real, found, 0).astype(np.int32), real.astype(np.float32)


def _summary(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Inputs of the last step for each document."""
    starts = np.searchsorted(doc, np.arange(n_docs))
    n = np.bincount(doc, minlength=n_docs)
    top = np.maximum.reduceat(logits, starts)
    mean = np.add.reduceat(1 / (1 + np.exp(-np.clip(logits, -30, 30))), starts) / n
    return np.stack((np.ones(n_docs), np.clip(top, -20, 20), 4 * mean, np.log(n)), 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = x.T @ (w * (p - y)) + ridge * beta
        beta = beta - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), step)
    return beta


def train(texts: list[bytes], toxic: np.ndarray, share: float, settings: Settings = Settings()) -> Model | None:
    """Fit on the sample; ``share`` is the label's share among all labelled rows."""
    toxic = np.asarray(toxic, np.float32)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(settings, None, None, None, None, share)
    size, n = 1 << BITS, len(texts)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    vocabulary = list(number)
    fold = np.arange(n) % settings.folds
    word_key = _word_keys(vocabulary)
    pieces, starts = _all_pieces(vocabulary)
    seen = np.zeros((settings.folds, 2, 2, size), np.float32)  # fold, word or piece, label, feature
    for i, ids in enumerate(docs):
        own = np.unique(ids)
        seen[fold[i], 0, int(toxic[i]), np.unique(word_key[own])] += 1
        if len(own):
            length = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            keys = np.unique(pieces[:, at])
            seen[fold[i], 1, int(toxic[i]), keys[keys >= 0]] += 1
    del pieces
    total = seen.sum(0)

    def tables(left_out: int | None):
        held = np.zeros_like(total) if left_out is None else seen[left_out]
        rest = np.ones(n, bool) if left_out is None else fold != left_out
        n1, n0 = toxic[rest].sum(), (1 - toxic[rest]).sum()
        return [_weights(total[k, 1] - held[k, 1], total[k, 0] - held[k, 0], n1, n0) for k in (0, 1)]

    blank = np.zeros((1, FEATURES), np.float32)
    feats, base, span = [blank], 1, len(vocabulary)
    for f in range(settings.folds):
        feats.append(word_features(vocabulary, *tables(f)))
    feats = np.concatenate(feats)
    ids = np.concatenate([ids + base + span * fold[i] for i, ids in enumerate(docs)]) if span else np.zeros(0, np.int64)
    counts = np.fromiter(map(len, docs), np.int64, n)
    doc, first, length = cut_windows(counts, settings)
    win, real = _gather(ids, np.cumsum(counts) - counts, doc, first, length, settings)
    net = _init(settings)
    rng, moments, step = np.random.default_rng(settings.seed), {k: [0.0, 0.0] for k in net}, 0
    each = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum()) * n
    logits = feats[:, :5].clip(0).sum(1)[win].sum(1).astype(np.float32)
    first_of = np.searchsorted(doc, np.arange(n))
    per_doc = np.bincount(doc, minlength=n)
    for _ in range(settings.epochs):
        order = np.lexsort((-logits, doc))
        chosen = np.concatenate((order[first_of], order[first_of + np.minimum(per_doc - 1, 1)][toxic == 0]))
        rng.shuffle(chosen)
        for i in range(0, len(chosen), settings.batch):
            part = chosen[i : i + settings.batch]
            grads = _gradients(feats, win[part], real[part], toxic[doc[part]], each[doc[part]], net)
            step += 1
            for k, g in grads.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                net[k] = (net[k] - settings.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        for f in range(settings.folds):
            own = fold[doc] == f
            projected = project(np.concatenate((feats[:1], feats[base + span * f : base + span * (f + 1)])), net)
            logits[own] = window_logits(projected, np.where(win[own] > 0, win[own] - span * f, 0), real[own], net)
    prior = np.where(toxic == 1, share / toxic.sum(), (1 - share) / (1 - toxic).sum()) * n
    final = _logistic(_summary(logits, doc, n), toxic, prior)
    return Model(settings, *tables(None), net, final, share)


class Scorer:
    """Scores of whole texts, with the inputs of the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.number: dict[bytes, int] = {}
        if self.model.net is not None:
            self.projected = project(np.zeros((1, FEATURES), np.float32), self.model.net)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        known = len(number)
        get = number.get
        ids = [get(w) or number.setdefault(w, len(number) + 1) for w in words]
        if len(number) > known:
            fresh = list(number)[known:]
            more = project(word_features(fresh, self.model.word_table, self.model.piece_table), self.model.net)
            self.projected = {d: np.concatenate((self.projected[d], more[d])) for d in more}
        return np.array(ids, np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        model = self.model
        if model.net is None:
            return np.full(len(texts), model.prior)
        found = np.empty(len(texts))
        for a, b in chunks(texts):
            if len(self.number) > model.settings.vocabulary:
                self._clear()
            split = [words_of(t) for t in texts[a:b]]
            counts = np.fromiter(map(len, split), np.int64, b - a)
            ids = self._ids([w for words in split for w in words])
            doc, first, length = cut_windows(counts, model.settings)
            win, real = _gather(ids, np.cumsum(counts) - counts, doc, first, length, model.settings)
            logits = window_logits(self.projected, win, real, model.net)
            x = _summary(logits, doc, b - a) @ model.final
            found[a:b] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return found


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn from the labelled rows outside the held-out fifth; the sample is bounded by ``settings``."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where("_id is not null and _toxic in (0, 1)")
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
        .where(~held_out("_id"))
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(
        F.coalesce(F.length("_text"), F.lit(0)) <= settings.sample_chars
    )
    share = known.agg(F.sum("_toxic"), F.count("_toxic")).first()
    picks = None
    for label in (1, 0):
        own = known.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id", F.lit(settings.seed)), "_id").limit(settings.sample)
        picks = own if picks is None else picks.unionByName(own)
    # at most 2 * sample rows
    rows = texts.join(F.broadcast(picks), "_id").select("_id", "_toxic", "_text").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"], r["_text"] or ""))
    return train(
        [(r["_text"] or "").encode() for r in rows],
        np.array([r["_toxic"] for r in rows]),
        ((share[0] or 0) + 0.5) / (share[1] + 1),
        settings,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(raw_texts(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    scorer: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scorer:
            scorer.append(Scorer(shared.value))
        return batch.filter(pa.array(scorer[0](raw_texts(batch.column(at))) < limit))

    return map_batches(docs, run, docs.schema)
