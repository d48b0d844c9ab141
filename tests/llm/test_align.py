"""Groups, links and counts of pairs against loops over single tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glosswork.llm import align as al
from glosswork.llm import queries

P = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def letters():
    """Letters of byte-level entries and the bytes they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def plain_groups(libraries, text):
    """[(a ids, b ids, end)] token by token; empty where the texts don't join again."""
    a, b = libraries
    if not text:
        return []
    stands, whole = letters(), b" " + text.encode()
    side_a = [(i, bytes(stands[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    side_b = [(i, piece(i)) for i in b.encode(text)]
    if b"".join(x for _, x in side_a) != whole or b"".join(x for _, x in side_b) != whole:
        return []
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    got_a, got_b = [], []
    while i < len(side_a) or j < len(side_b):
        if end_a <= end_b and i < len(side_a):
            got_a.append(side_a[i][0])
            end_a += len(side_a[i][1])
            i += 1
        else:
            got_b.append(side_b[j][0])
            end_b += len(side_b[j][1])
            j += 1
        if end_a == end_b:
            out.append((got_a, got_b, end_a))
            got_a, got_b = [], []
    return out


def plain_rows(libraries, docs):
    found = [(d, plain_groups(libraries, t)) for d, t in docs]
    count = Counter(p for _, groups in found for p in {(x, y) for a, b, _ in groups for x in a for y in b})
    best = defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    rows = []
    for d, groups in found:
        links = [(x, y) for a, b, _ in groups for x in a for y in b]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        rows.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(rows, key=str)


def texts():
    rng = random.Random(11)
    alphabet = list("abcdeé ñ中文字\n\t .,0") + ["  ", "the", "tion", "́", "😀", "<|endoftext|>", "<s>", "<0x41>"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*out, None, "", " ", "   ", "\n", "▁", "a▁b", "\x00", "﻿", "ﬁ", "é", "Ａ", "<|endoftext|>", "<unk> </s>", "x" * 3000, "中" * 500, *out[:20]]


def test_query_against_single_tokens(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op11_event_sweep"](spark, small).collect()), key=str)
    assert got == plain_rows(libraries, docs)
    assert sum(r[1] > 0 for r in got) > 150


@pytest.mark.parametrize("frame, block, rows", [(1 << 16, None, 10_000), (16, 50, 7), (1, 1, 1)])
def test_odd_texts_in_any_frames_and_blocks(spark, libraries, frame, block, rows):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    docs = list(enumerate(texts())) + [(None, "the cat"), (3, "the cat")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id int, text string, block int, rid string")
    try:
        got = sorted(map(tuple, al.measure(df, A_FILE, B_FILE, frame_bytes=frame, block_links=block).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == plain_rows(libraries, docs)


def test_machine_over_batches_cut_anywhere(libraries):
    """The machine on frames of a few bytes, in batches of any size, gives the groups of single tokens."""
    import pyarrow as pa

    byte_side, piece_side = al.byte_side(open(A_FILE, "rb").read()), al.piece_side(open(B_FILE, "rb").read())
    rng, rows, want = random.Random(5), [], {}
    for rid, text in enumerate(t for t in texts() if t):
        want[rid] = plain_groups(libraries, text)
        frames = []
        if not want[rid]:
            frames.append((0, 0, b""))
        else:
            for side, (encode, by_id) in enumerate((byte_side, piece_side)):
                ids = np.array(encode([text])[0], np.int32)
                ends = np.cumsum([len(by_id[i]) for i in ids])
                for f in np.unique((ends - 1) // 8).tolist():
                    here = (ends - 1) // 8 == f
                    frames.append((f, side, al._pack(ends[here], ids[here])))
        rows += [(rid, f"k{rid}", at, side, data) for at, side, data in sorted(frames)]
    batches, i = [], 0
    while i < len(rows):
        n = rng.randint(1, 9)
        cols = list(zip(*rows[i : i + n], strict=True))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "doc_id", "at", "side", "events"]))
        i += n
    got = defaultdict(list)
    for docs, of, done in al._swept(iter(batches)):
        a, b = np.cumsum(done.a_of), np.cumsum(done.b_of)
        for g, d in enumerate(of.tolist()):
            got[docs[d][0]].append((done.a[a[g] - done.a_of[g] : a[g]].tolist(), done.b[b[g] - done.b_of[g] : b[g]].tolist(), int(done.ends[g])))
        for d, _ in docs:
            got[d] += []
    assert dict(got) == want


def test_links_of_large_groups():
    done = al.Closed(np.array([1, 1, 2, 7]), np.array([5, 6, 5, 9]), np.array([3, 1]), np.array([3, 1]), np.array([10, 12]))
    want = Counter((a * al.IDS + b, g) for g, (x, y) in enumerate((([1, 1, 2], [5, 6, 5]), ([7], [9]))) for a in x for b in y)
    for listed in (0, 4096):
        al_listed, al.LISTED = al.LISTED, listed
        got = Counter()
        for p, g, t in zip(*al.linked(done), strict=True):
            got[int(p), int(g)] += int(t)
        al.LISTED = al_listed
        assert got == want


def test_groups_as_rows(spark, libraries):
    docs = [(1, "hello, world"), (2, "ﬁx"), (1, "again\nagain"), (3, None)]
    got = al.align(spark.createDataFrame(docs, "doc_id long, text string"), A_FILE, B_FILE).collect()
    by_row = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["row"], r["group"])):
        assert r["start"] == (by_row[r["row"]][-1][2] if by_row[r["row"]] else 0)
        by_row[r["row"]].append((r["a"], r["b"], r["end"]))
    assert sorted(by_row.values(), key=str) == sorted((g for _, t in docs if (g := plain_groups(libraries, t))), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.measure(df, A_FILE, B_FILE).count() == 0
    assert al.align(df, A_FILE, B_FILE).count() == 0
