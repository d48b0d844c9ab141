"""Language of texts and of the spans of mixed texts: script ranges, trigram scores, Viterbi.

A word's script narrows its candidates to the languages that were seen to use that script. Its score for each
candidate is the sum of its trigrams' log probabilities. Viterbi over a text's words, at a price for every change of language,
labels each word; equal neighbours are a span. A span's letters are dealt to languages by the
probabilities of the span's summed scores, and the language with most letters is the text's.

Trigrams are counted by Spark over a bounded sample of the labelled documents; what goes to workers is a
table of fixed size. Texts are labelled where they are read: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glosswork.llm.common import bound_batches, table

#: Bound of the training sample: documents of each language, those of the smallest hashes.
TRAIN_DOCS = 1000
#: Hashed trigrams, at most; fewer if there are so many languages that the table would pass MODEL_BYTES.
TRIGRAMS, MODEL_BYTES = 1 << 16, 32 << 20
#: Parts that a language's rows are drawn from.
SALTS = 64
#: Tasks that count the sample.
COUNTING_TASKS = 16
#: Least share of a language's letters that a script must have to be one of its scripts.
SCRIPT_SHARE = 0.01
#: Price of a change of language between two words, in nats.
SWITCH = 12.0
#: Added to every count of a trigram.
SMOOTHING = 0.5
#: Bytes of text that are labelled together; a longer text is taken alone.
GROUP_BYTES = 8 << 20
#: Language of texts without letters.
UNDETERMINED = "und"

#: First and last code points of the scripts' main blocks. What lies in none is a script of its own.
SCRIPTS = [
    ("latin", 0x41, 0x24F),
    ("latin extended", 0x250, 0x2AF),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F),
    ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F),
    ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF),
    ("burmese", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul jamo", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("latin additional", 0x1E00, 0x1EFF),
    ("greek extended", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
_FIRST = np.array([s[1] for s in SCRIPTS], np.int64)
_LAST = np.array([s[2] for s in SCRIPTS], np.int64)
#: A word: letters and the marks that follow them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point; one more than the last for any other."""
    at = np.searchsorted(_FIRST, points, "right") - 1
    inside = (at >= 0) & (points <= _LAST[np.maximum(at, 0)])
    return np.where(inside, at, len(SCRIPTS))


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of each word between marks, end to end, where each word's begin, and the word's script."""
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    code = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    with np.errstate(over="ignore"):
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # what would reach into the next word
        inside[ends[:-1] - back] = False
    return (code[inside] & np.uint64(buckets - 1)).astype(np.int64), np.cumsum(sizes - 2) - (sizes - 2), scripts_of(points[ends - sizes + 1].astype(np.int64))


@dataclass
class Model:
    """Languages in the order of their names, log probabilities of trigrams (buckets x languages), which script each uses (scripts x languages)."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: scores of languages, the best 0; languages that don't use its script are out of reach, unless no language does."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        grams, begin, script = features(words, len(self.logs))
        out = np.add.reduceat(self.logs[grams], begin, axis=0)
        uses = self.uses[script]
        out = np.where(uses | ~uses.any(axis=1)[:, None], out, -np.inf)
        return np.maximum(out - out.max(axis=1)[:, None], -1e6).astype(np.float32)


def viterbi(ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word of many texts at once, ids (rows of ``scores``) end to end; ties to the language before, then to the first.

    Step t handles the t-th word of every text that has one; texts are in the order of their lengths, so those are the first ones.
    """
    labels = np.zeros(len(ids), np.int8 if scores.shape[1] < 128 else np.int32)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    begin = (np.cumsum(sizes[np.argsort(order)]) - sizes[np.argsort(order)])[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left").tolist()  # texts of more than t words
    stays, leaders = [], []
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    final = np.zeros(len(sizes), np.int64)
    for t in range(steps):
        n = active[t]
        value = value[:n]
        if t:
            leader = value.argmax(axis=1)
            value = value - value[np.arange(n), leader][:, None]  # the best is 0, so sums stay small
            stay = value >= -switch
            stays.append(stay)
            leaders.append(leader)
            value = np.where(stay, value, -switch)
        value = value + scores[ids[begin[:n] + t]]
        n_next = active[t + 1] if t + 1 < steps else 0
        if n_next < n:
            final[n_next:n] = value[n_next:].argmax(axis=1)
    at = np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if t + 1 < steps:
            m = active[t + 1]
            at = np.where(stays[t][np.arange(m), at], at, leaders[t])
        at = np.concatenate([at, final[len(at) : n]])
        labels[begin[:n] + t] = at
    return labels


def label(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and spans: the text and first and last-but-one word (within all words end to end) of each, and its probabilities of languages."""
    words = [WORD.findall(t.lower()) for t in texts]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    scores = model.scores(list(number))
    labels = viterbi(ids, sizes, scores, switch)
    doc = np.repeat(np.arange(len(words)), sizes)
    heads = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    tails = np.append(heads[1:], len(ids))[: len(heads)]
    if not len(heads):
        return words, doc[heads], heads, tails, np.zeros((0, len(model.languages)))
    total = np.add.reduceat(scores[ids].astype(np.float64), heads, axis=0)
    p = np.exp(total - total.max(axis=1)[:, None])
    return words, doc[heads], heads, tails, p / p.sum(axis=1)[:, None]


def train(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = TRAIN_DOCS) -> Model:
    """A model of the languages that ``docs`` names, from at most ``per_language`` documents of each, those whose ids hash lowest.

    Rows without a language or text don't count; ids are only hashed, and a null id is one like any other. Rows that repeat an id that was drawn are drawn too. Without any row the model knows no language.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("draw"), F.col(lang).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    drawn = rows.select("lang", "draw").withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):  # the lowest of each salt first, so that the last sort of a language meets SALTS times as many rows as are drawn, at most
        drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("draw"))).where(F.col("rank") <= per_language)
    drawn = drawn.select("lang", "draw").distinct()
    sample = rows.join(F.broadcast(drawn), ["lang", "draw"]).select("lang", "text").repartition(COUNTING_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if name not in grams:
                    grams[name], letters[name] = np.zeros(TRIGRAMS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
                if words := WORD.findall(text.as_py().lower()):
                    found, _, script = features(words, TRIGRAMS)
                    grams[name] += np.bincount(found, minlength=TRIGRAMS)
                    letters[name] += np.bincount(script, list(map(len, words)), len(SCRIPTS) + 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([v.tobytes() for v in grams.values()], pa.binary()), pa.array([v.tobytes() for v in letters.values()], pa.binary())], names=["lang", "grams", "letters"])

    def add(part: pa.Table) -> pa.Table:
        total = {c: sum(np.frombuffer(v, np.int64) for v in part.column(c).to_pylist()) for c in ("grams", "letters")}
        return pa.table({"lang": part.column("lang").slice(0, 1), "grams": pa.array([total["grams"].tobytes()], pa.binary()), "letters": pa.array([total["letters"].tobytes()], pa.binary())})

    schema = "lang string, grams binary, letters binary"
    found = sorted(map(tuple, sample.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect()))
    if not found:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    buckets = TRIGRAMS
    while buckets > 1024 and buckets * len(found) * 4 > MODEL_BYTES:
        buckets //= 2
    counts = np.stack([np.frombuffer(g, np.int64).reshape(-1, buckets).sum(axis=0) for _, g, _ in found], axis=1) + SMOOTHING
    letters = np.stack([np.frombuffer(x, np.int64) for _, _, x in found], axis=1)
    uses = letters > SCRIPT_SHARE * letters.sum(axis=0)
    return Model([name for name, _, _ in found], np.log(counts / counts.sum(axis=0)).astype(np.float32), uses)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of some rows at a time."""
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            j, size, texts = i, 0, []
            while j < batch.num_rows and (j == i or size < GROUP_BYTES):
                texts.append(batch.column("text")[j].as_py() or "")
                size += len(texts[-1])
                j += 1
            yield batch.column("doc_id").slice(i, j - i), texts
            i = j


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language with most letters in the text's spans, and its share of them.

    Ties go to the name that sorts first. ``und`` and 0.0 where the text is null or has no letter, or the model knows no language. A text in a script that no
    learned language uses is still scored. Rows that repeat are labelled each, texts of any length whole; an empty table gives an empty one; ids
    of any type, nulls too, pass through; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value.languages
        for ids, texts in _groups(batches):
            best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if names:
                words, doc, heads, tails, p = label(texts, held.value, switch)
                letters = np.concatenate([[0], np.cumsum(np.fromiter((len(w) for ws in words for w in ws), np.int64))])
                mass = np.zeros((len(texts), len(names)))
                np.add.at(mass, doc, (letters[tails] - letters[heads])[:, None] * p)
                total, top = mass.sum(axis=1), mass.argmax(axis=1).tolist()
                score = np.clip(mass.max(axis=1) / np.maximum(total, 1), 0, 1)
                best = [names[k] if t > 0 else UNDETERMINED for k, t in zip(top, total.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(key_type), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, span, start, end, lang, score): the spans of one language of every row, numbered from 0, with the code points they begin and end at.

    A span goes from its first word to its last; ``score`` is the probability of its language. Rows without letters have no spans. See ``identify`` for odd rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value.languages
        for ids, texts in _groups(batches):
            if not names:
                continue
            # lower case letter by letter, as some letters' lower case is longer than they are
            texts = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
            words, doc, heads, tails, p = label(texts, held.value, switch)
            places = [m.span() for t in texts for m in WORD.finditer(t)]
            first = np.searchsorted(doc, np.arange(len(texts)))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc)).cast(key_type), pa.array(np.arange(len(doc)) - first[doc], pa.int64()), pa.array([places[h][0] for h in heads.tolist()], pa.int64()), pa.array([places[t - 1][1] for t in tails.tolist()], pa.int64()),
                    pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(p.max(axis=1) if len(p) else np.zeros(0), pa.float64()),
                ],
                names=["doc_id", "span", "start", "end", "lang", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, span long, start long, end long, lang string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is outside the learning fold."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0


def op13_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model that learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
