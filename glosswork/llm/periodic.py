"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a maximal stretch of smallest period q and at least ``max(6, 4 q)`` words. Shifted by q
it overlaps itself in ``max(6 - q, 3 q)`` words or more, five at the least, so each of its
words lies in a 5-gram that its document holds again: words outside such grams join
no run and go first, for a whole batch of documents in one sort. Stretches that survive are halved again and again;
at each middle, Z functions give how far every period reaches to both sides, so a
stretch of n words takes n log n steps. Documents are scanned where they are read, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glosswork.llm.common import bound_batches, table

#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 6, 4
#: Words by which every run overlaps itself when shifted by its period: the least of max(LEAST, FOLD q) - q over all q.
GRAM = min(max(LEAST, FOLD * q) - q for q in range(1, LEAST + 1))
#: Bytes of text whose words are numbered together; a longer text is taken alone.
GROUP_BYTES = 2 << 20


def z_function(s: list) -> list[int]:
    """For each place of ``s`` how long the sequence from there agrees with its beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(w: list[int], low: int, mid: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of long enough stretches of ``w[low:high]`` that hold both sides of ``mid``."""
    most = (high - low) // FOLD
    u, v = w[low:mid], w[mid:high]
    # the period's first copy right of the middle: from mid to mid + p
    p_right = min(most, len(v))
    forth = z_function(v[: len(v)])
    back = z_function([*u[::-1], -1, *w[low : mid + p_right][::-1]])
    at = len(u) + 1 + p_right
    for p in range(1, p_right + 1):
        before = back[at - p]
        if before:
            length = before + p + (forth[p] if p < len(v) else 0)
            if length >= LEAST and length >= FOLD * p:
                yield mid - before, mid - before + length, p
    # and left of it: from mid - p to mid
    p_left = min(most, len(u))
    back = z_function(u[::-1])
    forth = z_function([*v, -1, *w[mid - p_left : high]])
    at = len(v) + 1 + p_left
    for p in range(1, p_left + 1):
        after = forth[at - p]
        if after:
            length = after + p + (back[p] if p < len(u) else 0)
            if length >= LEAST and length >= FOLD * p:
                yield mid + after - length, mid + after, p


def runs_within(w: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of ``w`` inside ``[low, high)``, by start and period; runs must not reach beyond it."""
    found: dict[tuple[int, int], int] = {}
    todo = [(low, high)]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        mid = (a + b) // 2
        for start, end, p in _across(w, a, mid, b):
            if start == a and start > low and w[start - 1] == w[start - 1 + p]:
                continue  # cut off by this part: it was found where it crosses an earlier middle
            if end == b and end < high and w[end] == w[end - p]:
                continue
            if p < found.get((start, end), p + 1):
                found[start, end] = p
        todo += [(a, mid), (mid, b)]
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def surviving(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of stretches whose words all lie in grams that their document repeats.

    ``ids`` are the numbered words of documents end to end, ``sizes`` their numbers of words. Grams
    are told apart by 64-bit hashes; two that collide would survive for nothing and change no result.
    """
    none = np.zeros(0, np.int64)
    n = len(ids)
    if n < LEAST:
        return none, none
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(1)
        h = doc[: n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93)
        for k in range(GRAM):
            h = (h ^ (h >> np.uint64(31)) ^ x[k : n - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes)[: n - GRAM + 1] - np.arange(n - GRAM + 1)  # words to the end of the document
    places = np.flatnonzero(left >= GRAM)
    order = places[np.argsort(h[places], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, order[again], 1)
    np.add.at(step, order[again] + GRAM, -1)
    alive = np.cumsum(step[:-1]) > 0
    starts = np.zeros(n, bool)
    starts[(ends - sizes)[sizes > 0]] = True
    first = np.flatnonzero(alive & (starts | ~np.concatenate([[False], alive[:-1]])))
    last = np.flatnonzero(alive & np.concatenate([starts[1:] | ~alive[1:], [True]])) + 1
    long = last - first >= LEAST
    return first[long], last[long]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, end, period)."""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for words in texts for w in words]
    sizes = np.array([len(words) for words in texts], np.int64)
    first, last = surviving(np.array(ids, np.int64), sizes)
    begin = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, a, b in zip((np.searchsorted(begin, first, "right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
        d0 = int(begin[d])
        out[d] += [(s - d0, e - d0, p) for s, e, p in runs_within(ids, a, b)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = [0] * (len(words) + 1)
    for s, e, p in runs:
        step[s + p] += 1
        step[e] -= 1
    return [w for w, held in zip(words, accumulate(step), strict=False) if not held]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(start, length, period) of the greatest exponent, ties to the smaller start, then period."""
    best = None
    for s, e, p in runs:  # by start and period
        if best is None or (e - s) * best[2] > best[1] * p:
            best = (s, e - s, p)
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of each row's words ``[^\\x20\\x09-\\x0D]+``.

    (doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), the middle four of the run
    of greatest exponent and null without one; ``with_runs`` adds runs, an array of (start, length, period), ``with_text`` adds collapsed, the
    words left. Null and blank texts have no words: no runs, hashes of nothing. Rows that repeat are
    scanned each, texts of any length whole; an empty table gives an empty one; ids of any type, nulls too, pass through; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    fields = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    fields += [("runs", run_type)] * with_runs + [("collapsed", pa.string())] * with_text
    key_type = to_arrow_type(kind)

    def measured(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        best = _best(runs)
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        left = b" ".join(collapse(words, runs))
        row = [len(words), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
        if with_runs:
            row.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs])
        if with_text:
            row.append(left.decode())
        return tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text").cast(pa.binary())]
            i = 0
            while i < batch.num_rows:
                j, size = i + 1, sizes[i]
                while j < batch.num_rows and size + sizes[j] <= GROUP_BYTES:
                    size += sizes[j]
                    j += 1
                texts = [(t or "").encode().split() for t in batch.column("text").slice(i, j - i).to_pylist()]
                out = [measured(w, r) for w, r in zip(texts, runs_of(texts), strict=True)]
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(key_type), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])
                i = j

    schema = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>" * with_runs + ", collapsed string" * with_text
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, {schema}")


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A text; where h, its id's checksum, ends in 0, its n words with a periodic tail: word i from a on is word a + (i - a) % p.

    With g = h div 10: a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts, and those without words or id, stay as they are.
    """
    h = f"crc32(encode(cast(`{id_col}` as string), 'UTF-8'))"
    words = f"filter(split(`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')"
    tail = f"""transform(array(named_struct('w', {words}, 'g', {h} div 10)), x -> if(size(x.w) = 0, '', array_join(
        transform(array(named_struct('n', size(x.w), 'a', cast(x.g % size(x.w) as int))), y ->
        transform(x.w, (v, i) -> if(i < y.a, v, x.w[y.a + (i - y.a) % cast(1 + (y.n - y.a) div (3 + x.g % 8) as int)])))[0], ' ')))[0]"""
    return F.expr(f"case when {h} % 10 = 0 and `{text_col}` is not null then {tail} else `{text_col}` end")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a planted periodic tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    return scan(docs).drop("n_words")


#: Another way to the same rows: names of grams of doubling length; within a run of period q the next equal gram of at least q words is q away.
OP12_SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b, t FROM documents, t),
h AS (SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS h FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
x AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
u AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM x),
r AS (
  SELECT CAST(1 AS BIGINT) AS k, rid, i, dense_rank() OVER (PARTITION BY rid ORDER BY word) AS name FROM u
  UNION ALL
  SELECT k, rid, i, name FROM (
    SELECT *, count(*) OVER (PARTITION BY rid, name) AS times FROM (
      SELECT 2 * l.k AS k, l.rid, l.i, dense_rank() OVER (PARTITION BY l.rid ORDER BY l.name, m.name) AS name FROM r l JOIN r m ON l.rid = m.rid AND m.i = l.i + l.k)) WHERE times > 1),
g AS (SELECT k, rid, i, lead(i) OVER (PARTITION BY k, rid, name ORDER BY i) - i AS q FROM r),
s AS (SELECT k, rid, i, q, i - row_number() OVER (PARTITION BY k, rid, q ORDER BY i) AS island FROM g WHERE q <= k AND 2 * q > k),
runs AS (SELECT rid, min(i) AS start, count(*) + k - 1 + q AS length, q AS period FROM s GROUP BY rid, k, q, island HAVING count(*) + k - 1 + q >= greatest(6, 4 * q)),
best AS (SELECT rid, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""
