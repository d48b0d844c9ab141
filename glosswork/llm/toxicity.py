"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its embedding plus the mean of its character trigrams'. Windows
of WINDOW words that overlap by half are read by a recurrent network in both directions;
attention pools the states into a logit. A document scores as its highest
window, so every word of every text counts.

``learn`` trains on all labelled documents (but for a held-out fold, if one is asked for), in Spark: words are counted by class over all of
them, each document's most telling window is chosen where the document lies, and windows are
dealt to blocks that descend apart and are averaged round by round. Then each document's
highest window is chosen anew by the network, and so on. ``train`` does the like on texts in memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import BROADCAST_BYTES, bound_batches, fresh, materialise, small_or_shuffled, table

WINDOW, STRIDE = 32, 16
EMBED, HIDDEN, ATTEND = 16, 8, 8
TRIGRAMS = 8192
WORDS = 8192
#: Bound of ``training_sample``: documents of each class, and characters of a document that may train.
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 2000, 4000, 10_000
#: Windows of a block, about; times that windows are chosen and rounds for each choice, with several blocks; choices with a single one.
BLOCK_WINDOWS, CHOICES, ROUNDS, CHOICES_OF_ONE = 24_000, 3, 3, 6
#: Words that a task counts before it hands its counts on, bytes of a word that may enter the vocabulary, weights that are averaged in one group.
COUNTED, LONGEST_WORD, SLOT = 200_000, 64, 4096
#: Bits of the map of labelled documents.
MARKS = 1 << 24
EPOCHS, BATCH, RATE = 8, 256, 0.01
#: Steps that a small sample trains at least, by more epochs and smaller batches; and most epochs.
LEAST_STEPS, MOST_EPOCHS = 350, 60
#: Bytes of text scored at a time, and words of one text read at a time: a stride less than a window more than whole strides.
SCORE_BYTES = 2 << 20
SEGMENT = (1 << 17) + WINDOW - STRIDE

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAD_GATE = 30.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each word between marks, one after the other, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # trigrams that would reach into the next word
        at = ends[:-1] - back
        inside[at[at < len(code)]] = False
    code = ((code[inside] * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(TRIGRAMS)
    return code.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])


@dataclass
class Model:
    """Weights; ``vocabulary`` maps frequent words to rows of ``word``, row 0 is every other word."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def start(vocabulary: dict[bytes, int], seed: int = 6) -> Model:
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"word": np.zeros((len(vocabulary) + 1, EMBED), np.float32), "char": (rng.standard_normal((TRIGRAMS, EMBED)) * 0.3).astype(np.float32)}
        for d in ("f", "b"):
            w |= {f"x{d}": near(EMBED, 3 * HIDDEN), f"h{d}": near(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"a": near(2 * HIDDEN, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": near(ATTEND), "o": near(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
        return Model(vocabulary, w)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Inputs of distinct words; the last row stands for padding."""
        ids = np.fromiter((self.vocabulary.get(x, 0) for x in words), np.int64, len(words))
        if not words:
            return np.zeros((1, EMBED), np.float32), (ids, np.zeros(0, np.int64), ids, ids)
        code, begin = trigrams(words)
        many = np.diff(np.append(begin, len(code)))
        x = np.add.reduceat(self.weights["char"][code], begin, axis=0) / many[:, None] + self.weights["word"][ids]
        return np.concatenate([x, np.zeros((1, EMBED))]).astype(np.float32), (ids, code, begin, many)

    def table(self, words: list[bytes], step: int = 1 << 15) -> np.ndarray:
        """Inputs of many distinct words, worked out in steps so that their trigrams' rows never lie in memory together."""
        parts = [self.inputs(words[i : i + step])[0][:-1] for i in range(0, len(words), step)]
        return np.concatenate([*parts, np.zeros((1, EMBED), np.float32)])

    def run(self, x: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows ``rows`` (n, WINDOW) over input rows ``x``; with ``keep`` also what the gradient needs."""
        w, n, pad = self.weights, len(rows), len(x) - 1
        states, memory = np.empty((WINDOW, n, 2 * HIDDEN), np.float32), {}
        for k, d in enumerate("fb"):
            given = x @ w[f"x{d}"] + w[f"c{d}"]
            given[pad] = 0
            given[pad, HIDDEN : 2 * HIDDEN] = _PAD_GATE  # padding leaves the state as it is
            h, steps = np.zeros((n, HIDDEN), np.float32), range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
            for t in steps:
                g, u = given[rows[:, t]], h @ w[f"h{d}"]
                gates = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])) + 0.5
                r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                after = new + z * (h - new)
                if keep:
                    memory[d, t] = (h, r, z, new, u[:, 2 * HIDDEN :])
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h = after
        look = np.tanh(states @ w["a"] + w["ab"])
        score = np.where(rows.T == pad, np.float32(-1e9), look @ w["v"])
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ w["o"] + w["ob"][0]
        return (logits, (states, look, weight, pooled, memory)) if keep else logits

    def gradient(self, words: list[bytes], rows: np.ndarray, target: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted mean log loss over windows."""
        w = self.weights
        x, (ids, code, begin, many) = self.inputs(words)
        logits, (states, look, weight, pooled, memory) = self.run(x, rows, keep=True)
        n, pad = len(rows), len(x) - 1
        d_logit = ((1 / (1 + np.exp(-np.clip(logits, -60, 60))) - target) * cost / cost.sum()).astype(np.float32)
        grad = {"o": pooled.T @ d_logit, "ob": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * w["o"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_look = d_score[..., None] * w["v"] * (1 - look**2)
        grad["v"] = np.einsum("tn,tna->a", d_score, look)
        grad["a"] = np.einsum("tnh,tna->ha", states, d_look)
        grad["ab"] = d_look.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pool + d_look @ w["a"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            d_given, d_hidden = np.empty((WINDOW, n, 3 * HIDDEN), np.float32), np.zeros_like(w[f"h{d}"])
            back, steps = np.zeros((n, HIDDEN), np.float32), range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW)
            for t in steps:
                h, r, z, new, u = memory[d, t]
                dh = back + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = dh * (1 - z) * (1 - new**2)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_u = np.concatenate([d_r, d_z, d_new * r], axis=1)
                d_given[t] = np.concatenate([d_r, d_z, d_new], axis=1)
                d_hidden += h.T @ d_u
                back = dh * z + d_u @ w[f"h{d}"].T
            flat, at = d_given.reshape(-1, 3 * HIDDEN), rows.T.reshape(-1)
            flat[at == pad] = 0
            total = np.stack([np.bincount(at, flat[:, j], len(x)) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
            grad |= {f"h{d}": d_hidden, f"c{d}": total.sum(axis=0), f"x{d}": x.T @ total}
            d_x += total @ w[f"x{d}"].T
        d_x = d_x[:-1]
        grad["word"] = np.stack([np.bincount(ids, d_x[:, j], len(w["word"])) for j in range(EMBED)], axis=1).astype(np.float32)
        grad["word"][0] = 0
        each = np.repeat(d_x / many[:, None], many, axis=0)
        grad["char"] = np.stack([np.bincount(code, each[:, j], TRIGRAMS) for j in range(EMBED)], axis=1).astype(np.float32)
        return grad

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability for each whole text."""
        logits = self.logits([words_of(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60)))

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        """Highest window logit of each document. A long one is read in segments whose windows are those of the whole."""
        if not docs:
            return np.zeros(0)
        if not self.weights:
            return np.zeros(len(docs))
        parts = [segments(len(d)) for d in docs]
        if max(map(len, parts)) > 1:
            return np.array([max(float(self.logits([d[a:b]])[0]) for a, b in cut) for d, cut in zip(docs, parts, strict=True)])
        words, rows, first = windows(docs)
        return np.maximum.reduceat(self.each(self.table(words), rows), first)

    def each(self, x: np.ndarray, rows: np.ndarray, step: int = 4096) -> np.ndarray:
        return np.concatenate([self.run(x, rows[i : i + step]) for i in range(0, len(rows), step)])


def segments(n: int, size: int = SEGMENT) -> list[tuple[int, int]]:
    """Parts of a text of ``n`` words that overlap so that their windows together are the windows of the whole."""
    begin = [0]
    while begin[-1] + size < n:
        begin.append(min(begin[-1] + size - WINDOW + STRIDE, (n - WINDOW) // STRIDE * STRIDE))
    return [(a, min(a + size, n)) for a in begin]


def windows(docs: Iterable[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, all overlapping windows as rows of word numbers, and each document's first window.

    A text shorter than a window is padded by one past the last number; the last window ends with the text.
    """
    number: dict[bytes, int] = {}
    flat = [np.fromiter((number.setdefault(w, len(number)) for w in d), np.int32, len(d)) for d in docs]
    pad, sizes = len(number), np.fromiter(map(len, flat), np.int64, len(flat))
    whole = np.concatenate([np.append(f, np.full(WINDOW - len(f), pad, np.int32)) if len(f) < WINDOW else f for f in flat])
    held = np.maximum(sizes, WINDOW)
    offset = np.cumsum(held) - held
    many = -(-(held - WINDOW) // STRIDE) + 1
    first = np.cumsum(many) - many
    nth = np.arange(many.sum()) - np.repeat(first, many)
    start = np.repeat(offset, many) + np.minimum(nth * STRIDE, np.repeat(held - WINDOW, many))
    return list(number), whole[start[:, None] + np.arange(WINDOW)], first


def hints(words: list[bytes], rows: np.ndarray, first: np.ndarray, toxic: np.ndarray, use: np.ndarray) -> np.ndarray:
    """For each window, how much more often its most telling word and that word's trigrams stand in toxic documents.

    Which windows of a toxic document are toxic isn't known at first; this says where to begin.
    """
    last = np.append(first[1:], len(rows))
    seen = np.zeros((2, len(words) + 1))
    for i in use:
        seen[int(toxic[i]), np.unique(rows[first[i] : last[i]])] += 1
    docs = np.array([(toxic[use] == 0).sum(), (toxic[use] == 1).sum()])
    odds = lambda clean, bad: np.log((bad + 0.1) / docs[1]) - np.log((clean + 0.1) / docs[0])
    score = np.full(len(words) + 1, -1e9)
    for i in range(0, len(words), 1 << 15):
        code, begin = trigrams(words[i : i + (1 << 15)])
        many = np.diff(np.append(begin, len(code)))
        if i == 0:
            bad, clean = np.zeros(TRIGRAMS), np.zeros(TRIGRAMS)
        np.add.at(clean, code, np.repeat(seen[0, i : i + len(many)], many))
        np.add.at(bad, code, np.repeat(seen[1, i : i + len(many)], many))
    for i in range(0, len(words), 1 << 15):
        code, begin = trigrams(words[i : i + (1 << 15)])
        many = np.diff(np.append(begin, len(code)))
        score[i : i + len(many)] = np.add.reduceat(odds(clean, bad)[code], begin) / many
    score[:-1] += 0.5 * odds(seen[0, :-1], seen[1, :-1])
    return score[rows].max(axis=1)


def train(texts: list[str], toxic: np.ndarray, seed: int = 6) -> Model:
    """Fit on texts and 0/1 labels. With one class only, the model is that class's rate."""
    toxic = np.asarray(toxic, np.float32)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(shift=float(-4 if len(toxic) == 0 else np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))))
    seen = Counter(w for t in texts for w in set(words_of(t)))  # words are cut again below: all of them together would take the driver's memory
    frequent = sorted((w for w, k in seen.items() if k >= 5), key=lambda w: (-seen[w], w))[:WORDS]
    model = Model.start({w: i + 1 for i, w in enumerate(frequent)}, seed)
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2  # sets scale and shift, and the epoch that stays
    if len({*toxic[held]}) < 2 or len({*toxic[~held]}) < 2:
        held[:] = False
    del seen
    words, rows, first = windows(words_of(t) for t in texts)
    rows = rows.astype(np.int32)
    last = np.append(first[1:], len(rows))
    use = np.flatnonzero(~held)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    steps, best, hint = 0, None, hints(words, rows, first, toxic, use)
    batch = int(np.clip(len(use) // 6, 32, BATCH))
    epochs = int(np.clip(LEAST_STEPS * batch / (2 * len(use)), EPOCHS, MOST_EPOCHS))
    early = epochs // 4
    for epoch in range(epochs):
        pick = []
        logits = model.each(model.table(words), rows) if epoch >= early else None
        for i in use:
            a, b = first[i], last[i]
            if logits is None:  # at first those that hints name, and any other
                pick += [(a + int(np.argmax(hint[a:b])), i), (int(rng.integers(a, b)), i)] if not toxic[i] else [(a + int(np.argmax(hint[a:b])), i)] * 2
            else:
                pick.append((a + int(np.argmax(logits[a:b])), i))
                if not toxic[i]:
                    pick.append((int(rng.integers(a, b)), i))
        order = rng.permutation(len(pick))
        rate = RATE * (1.0 if epoch < 0.75 * epochs else 0.3)
        for s in range(0, len(order), batch):
            part = [pick[j] for j in order[s : s + batch]]
            steps += 1
            descend(model, words, rows[[p[0] for p in part]], toxic[[p[1] for p in part]], moment, steps, rate)
        if held.any() and epoch >= early:
            out = np.maximum.reduceat(model.each(model.table(words), rows), first)[held]
            fit = calibrate(out, toxic[held])
            if best is None or fit[2] < best[2]:
                best = (*fit, {k: v.copy() for k, v in model.weights.items()})
    if best:
        model.scale, model.shift, _, model.weights = best
    return model


def descend(model: Model, words: list[bytes], at: np.ndarray, y: np.ndarray, moment: dict, steps: int, rate: float) -> None:
    """One step on windows ``at`` of classes ``y``: moves the weights and their moments in place."""
    inner, local = np.unique(at, return_inverse=True)
    real = inner[inner < len(words)]
    local = np.where(at == len(words), len(real), local.reshape(at.shape))
    grad = model.gradient([words[j] for j in real], local, y, np.where(y > 0, 1.5, 1.0).astype(np.float32))
    for k, g in grad.items():
        m, v = moment[k]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        model.weights[k] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)


def calibrate(logits: np.ndarray, toxic: np.ndarray, count: np.ndarray | None = None) -> tuple[float, float, float]:
    """(scale, shift, mean log loss) of the logistic curve through document logits, lightly regularised; ``count`` documents share each."""
    a, b = 1.0, 0.0
    loss = np.inf
    mean = lambda x: np.average(x, weights=count)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))
        loss = float(-mean(np.where(toxic > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        d, q = p - toxic, p * (1 - p) + 1e-6
        grad = np.array([mean(d * logits) + 0.01 * (a - 1), mean(d) + 0.001 * b])
        curve = np.array([[mean(q * logits**2) + 0.01, mean(q * logits)], [mean(q * logits), mean(q) + 0.001]])
        step = np.linalg.solve(curve, grad)
        a, b = max(0.05, a - float(np.clip(step[0], -0.5, 0.5))), b - float(np.clip(step[1], -1, 1))
    return float(a), float(b), loss


def held_out(doc_id, folds: int = 5):
    """True for the fold that never trains."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """For trials with ``train``, no query uses it: at most TOXIC_DOCS and CLEAN_DOCS labelled texts outside the held-out fold, chosen by a hash of doc_id.

    Labels without doc_id or class don't count, of several for one document the highest does. Null and longer texts (TRAIN_CHARS) don't train; of rows
    that share a doc_id one does. Empty tables give no texts. Ids may be of any type; other columns are not read.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    by_hash = [F.xxhash64("doc_id", F.lit(6)), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*by_hash).limit(TOXIC_DOCS).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(CLEAN_DOCS))
    kind = known.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in some.collect()], f"doc_id {kind}, toxic int")  # bounded by the two parameters
    got = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(got.select("doc_id", "text", "toxic").collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.float32)


def best_windows(docs: list[list[bytes]], value: Callable[[list[bytes], np.ndarray], np.ndarray]) -> list[int]:
    """Where each document's window of highest value begins. Long ones are read in segments, few at a time."""
    best, part, size = [(-np.inf, 0)] * len(docs), [], 0

    def close() -> None:
        words, rows, first = windows([docs[i][a:b] for i, a, b in part])
        values = value(words, rows)
        for (i, a, b), s, e in zip(part, first, [*first[1:], len(rows)], strict=True):
            k = int(np.argmax(values[s:e]))
            best[i] = max(best[i], (float(values[s + k]), -(a + min(k * STRIDE, max(b - a - WINDOW, 0)))))  # the first of equals

    for i, d in enumerate(docs):
        for a, b in segments(len(d)):
            if part and size + max(b - a, WINDOW) > SEGMENT:
                close()
                part, size = [], 0
            part.append((i, a, b))
            size += max(b - a, WINDOW)
    if part:
        close()
    return [-at for _, at in best]


def batches_of_words(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """(hashes, classes, words) of some texts at a time."""
    for batch in batches:
        part, size = ([], [], []), 0
        for h, toxic, text in zip(*(batch.column(c) for c in ("h", "toxic", "text")), strict=True):
            text = text.as_py()
            for held, value in zip(part, (h.as_py(), toxic.as_py(), words_of(text)), strict=True):
                held.append(value)
            size += len(text or "")
            if size >= SCORE_BYTES:
                yield part
                part, size = ([], [], []), 0
        if part[0]:
            yield part


def count_words(rows: DataFrame) -> DataFrame:
    """(word, clean, bad): documents of each class that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "clean", "bad"])
            seen[0].clear()
            seen[1].clear()
            return out

        for _, classes, docs in batches_of_words(batches):
            for toxic, words in zip(classes, docs, strict=True):
                seen[toxic].update(set(words))
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield counted()
        yield counted()

    return rows.mapInArrow(run, "word binary, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))


def count_trigrams(words: DataFrame) -> DataFrame:
    """(trigram, clean, bad) from words and how many documents of each class hold them; a word's trigrams count as often as they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TRIGRAMS), np.int64)
        for batch in batches:
            held = batch.column("word").to_pylist()
            code, begin = trigrams(held)
            many = np.diff(np.append(begin, len(code)))
            for k, name in enumerate(("clean", "bad")):
                np.add.at(total[k], code, np.repeat(batch.column(name).to_numpy(), many))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TRIGRAMS, dtype=np.int32)), *map(pa.array, total)], names=["trigram", "clean", "bad"])

    return words.mapInArrow(run, "trigram int, clean long, bad long").groupBy("trigram").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))


def told(vocabulary: dict[bytes, float], by_trigram: np.ndarray) -> Callable[[list[bytes], np.ndarray], np.ndarray]:
    """Value of windows: how telling their most telling word is, by its trigrams and, if it is in the vocabulary, by itself. See ``hints``."""

    def value(words: list[bytes], rows: np.ndarray) -> np.ndarray:
        score = np.full(len(words) + 1, -1e9)
        for i in range(0, len(words), 1 << 15):
            some = words[i : i + (1 << 15)]
            code, begin = trigrams(some)
            score[i : i + len(some)] = np.add.reduceat(by_trigram[code], begin) / np.diff(np.append(begin, len(code)))
            score[i : i + len(some)] += 0.5 * np.fromiter((vocabulary.get(w, 0.0) for w in some), float, len(some))
        return score[rows].max(axis=1)

    return value


def chosen(rows: DataFrame, choice: int, blocks: int, model: Model, hint: tuple | None) -> DataFrame:
    """(block, picks): each document's window of highest value, by ``hint`` or by the model, and any other of a clean one, dealt to blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((model, hint))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, given = shared.value
        value = told(*given) if given else lambda words, at: network.each(network.table(words), at)
        for hashes, classes, docs in batches_of_words(batches):
            out = []
            for h, toxic, words, at in zip(hashes, classes, docs, best_windows(docs, value), strict=True):
                over = max(len(words) - WINDOW, 0)
                rng = np.random.default_rng([h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF, choice])
                other = min(int(rng.integers(-(-over // STRIDE) + 1)) * STRIDE, over)
                starts = [at, other] if not toxic else [at, at] if given else [at]  # at first as many of a toxic one
                out += [(h, kind, toxic, b" ".join(words[b : b + WINDOW])) for kind, b in enumerate(starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["h", "kind", "toxic", "words"])

    picks = rows.mapInArrow(run, "h long, kind int, toxic int, words binary").withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int"))
    return picks.repartition(blocks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("h", "kind", "toxic", "words"))).alias("picks"))


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: v.reshape(like[k].shape).astype(np.float32) for k, v in zip(sorted(like), np.split(values, ends), strict=True)}


def one_round(blocks: DataFrame, model: Model, nth: int, rounds: int, rate: float, least: float = 0, most: int = 1) -> dict[str, np.ndarray]:
    """Weights after each block's part ``nth`` of ``rounds`` of its steps, averaged by the blocks' windows.

    A block's steps pass over all its windows: once, or until they are ``least`` steps in at most ``most`` passes.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, picks in zip(batch.column("block"), batch.column("picks"), strict=True):
                values = picks.values
                toxic = values.field("toxic").to_numpy().astype(np.float32)
                words, at, _ = windows(w.as_py().split() for w in values.field("words"))
                n = len(toxic)
                size = int(np.clip(n // 12, 32, BATCH))
                passes = int(np.clip(round(least * size / n), 1, most))
                rng = np.random.default_rng([block.as_py(), nth // rounds])
                order = np.concatenate([rng.permutation(n) for _ in range(passes)])
                parts = np.array_split(order, max(rounds, -(-len(order) // size)))
                own = Model(shared.value.vocabulary, {k: v.copy() for k, v in shared.value.weights.items()})
                moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in own.weights.items()}
                lo, hi = (len(parts) * (nth % rounds + k) // rounds for k in (0, 1))
                for step, part in enumerate((p for p in parts[lo:hi] if len(p)), 1):
                    descend(own, words, at[part], toxic[part], moment, step, rate)
                all_weights = flat(own.weights)
                cut = [all_weights[i : i + SLOT].tobytes() for i in range(0, len(all_weights), SLOT)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([n] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["slot", "n", "part"])

    def averaged(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy().astype(float)
        total = sum(k * np.frombuffer(p.as_py(), np.float32).astype(float) for k, p in zip(n, group.column("part"), strict=True))
        return pa.table({"slot": group.column("slot")[:1].cast(pa.int32()), "part": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    got = blocks.mapInArrow(run, "slot int, n long, part binary").groupBy("slot").applyInArrow(averaged, "slot int, part binary").collect()  # the weights of one model
    return shaped(np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(got, key=lambda r: r["slot"])]), model.weights)


def logit_counts(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, logit, n): how many documents of a class have a logit, in hundredths."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, classes, docs in batches_of_words(batches):
            out = np.round(np.clip(shared.value.logits(docs), -60, 60) * 100).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(out)], names=["toxic", "logit"])

    return rows.mapInArrow(run, "toxic int, logit int").groupBy("toxic", "logit").agg(F.count(F.lit(1)).alias("n"))


def marked(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be one of ``known``'s, by a map of MARKS bits, so that few others are moved in a join of the two."""
    bit = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(MARKS))
    word, place = fresh(texts, "word"), (bit % 64).cast("int")
    bits = known.select(F.floor(bit / 64).alias(word), place.alias("place")).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))
    return texts.withColumn(word, F.floor(bit / 64)).join(F.broadcast(bits), word).where(F.getbit("bits", place) == 1).drop(word, "bits")  # at most MARKS / 64 rows


def labelled(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """(h, toxic, text) of every row of ``docs`` that has a label and is outside the held-out fold, or in any with ``whole``; ``h`` is a hash of its doc_id.

    Labels without doc_id or class don't count, of several for one document the highest does. Texts of any length train, null ones as empty,
    and so does each row of those that share a doc_id. Ids may be of any type; other columns are not read.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known if whole else known.where(~held_out(F.col("doc_id")))
    known, texts = materialise(known), docs.select("doc_id", "text")
    if (many := known.count()) * 16 > BROADCAST_BYTES and docs.schema["doc_id"].dataType == known.schema["doc_id"].dataType:
        texts = marked(texts, known)
    return texts.join(small_or_shuffled(known, many, 16), "doc_id").select(F.xxhash64("doc_id", F.lit(6)).alias("h"), "toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, seed: int = 6, whole: bool = False) -> Model:
    """Fit on all labelled documents outside the held-out fold, in Spark; what is collected is bounded by the model's size.

    With ``whole`` no fold is held out, for a model that nobody measures on one. A fifth of the documents sets scale and shift. With one class only, or none, the model is that class's rate.
    """
    bound_batches(docs.sparkSession)
    every = materialise(labelled(docs, labels, whole).withColumn("held", F.pmod(F.xxhash64("h"), F.lit(5)) == 0))
    cells = {(r["toxic"], r["held"]): r["n"] for r in every.groupBy("toxic", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, bad = (cells.get((k, False), 0) + cells.get((k, True), 0) for k in (0, 1))
    if not clean or not bad:
        return Model(shift=float(-4 if clean + bad == 0 else np.log((bad + 0.5) / (clean + 0.5))))
    parted = len(cells) == 4
    use = every.where("not held") if parted else every
    if parted:
        clean, bad = cells[0, False], cells[1, False]
    words = materialise(count_words(use))
    odds = lambda c, b: np.log((b + 0.1) / bad) - np.log((c + 0.1) / clean)
    top = words.where(f"clean + bad >= 5 and length(word) <= {LONGEST_WORD}").orderBy((F.col("clean") + F.col("bad")).desc(), "word").limit(WORDS).collect()
    by_trigram = np.zeros((TRIGRAMS, 2))
    for r in count_trigrams(words).collect():
        by_trigram[r["trigram"]] = r["clean"], r["bad"]
    model = Model.start({bytes(r["word"]): i + 1 for i, r in enumerate(top)}, seed)
    hint = ({bytes(r["word"]): float(odds(r["clean"], r["bad"])) for r in top}, odds(by_trigram[:, 0], by_trigram[:, 1]))
    blocks = -(-2 * (clean + bad) // BLOCK_WINDOWS)
    choices, rounds = (CHOICES, ROUNDS) if blocks > 1 else (CHOICES_OF_ONE, 1)
    repeat = () if blocks > 1 else (LEAST_STEPS / choices, MOST_EPOCHS // choices)  # a small block alone
    for choice in range(choices):
        picks = materialise(chosen(use, choice, blocks, model, None if choice else hint))
        rate = RATE * (1.0 if choice + 1 < choices else 0.3)
        for k in range(rounds):
            model = Model(model.vocabulary, one_round(picks, model, choice * rounds + k, rounds, rate, *repeat))
    if parted:
        got = logit_counts(every.where("held"), model).orderBy("toxic", "logit").collect()
        model.scale, model.shift, _ = calibrate(*(np.array([r[c] for r in got], float) / d for c, d in (("logit", 100), ("toxic", 1), ("n", 1))))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: whole texts, no shuffle. Null and blank texts score as an empty window.

    Rows that repeat are scored each, texts of any length in segments, and an empty table gives an empty one. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, part, size = [], [], 0
            for value in batch.column("text"):
                text = value.as_py()
                part.append(text)
                size += len(text or "")
                if size >= SCORE_BYTES:
                    scores.append(shared.value.score(part))
                    part, size = [], 0
            scores.append(shared.value.score(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores).astype(np.float64))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all columns whatever their names; rows that repeat go or stay each.

    Null and blank texts score as in ``score_documents``; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, part, size = [], [], 0
            for text in texts:
                part.append(text)
                size += len(text or "")
                if size >= SCORE_BYTES:
                    scores.append(shared.value.score(part))
                    part, size = [], 0
            scores.append(shared.value.score(part))
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; trained on all labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
