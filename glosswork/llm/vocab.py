"""Vocabulary files of public tokenizers. They are read on the driver and broadcast: their sizes are fixed."""

from __future__ import annotations

import base64
import hashlib
import json
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: No vocabulary file larger than this is broadcast.
MOST_BYTES = 32 << 20
#: String of the one reserved entry of the 50k vocabulary in its tokenizer file.
END_OF_TEXT = "<|endoftext|>"
#: Module and name of what the matcher raises when it gives up on a text.
PANIC = ("pyo3_runtime", "PanicException")


def share(spark: SparkSession, path: str) -> Broadcast:
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than {MOST_BYTES}")
    return spark.sparkContext.broadcast(data)


def ranks_of_tiktoken(data: bytes) -> dict[bytes, int]:
    """Byte pieces and their ranks, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _unicode_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(data: bytes) -> dict[bytes, int]:
    """Byte pieces and their ids, from a byte-level tokenizer file whose ids follow its merges."""
    letters, model = _unicode_bytes(), json.loads(data)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}


_built: dict[object, object] = {}
_digests: dict[int, tuple[bytes, str]] = {}


def _digest(data: bytes) -> str:
    """Digest of a file's content, remembered by the object that holds it."""
    held = _digests.get(id(data))
    if held is None or held[0] is not data:
        held = _digests[id(data)] = (data, hashlib.sha256(data).hexdigest())
    return held[1]


def encoding(data: bytes, special: dict[str, int] | None = None):
    """A tiktoken encoding from the content of a vocabulary file of either kind; built once in a process."""
    import public_tokenizers
    import tiktoken

    key = (_digest(data), repr(special))
    if key not in _built:
        ranks = ranks_of_json(data) if data.lstrip()[:1] == b"{" else ranks_of_tiktoken(data)
        _built[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})
    return _built[key]


def encode_like_tokenizers(data: bytes, text: str) -> list[int]:
    """The ids that the ``tokenizers`` library gives for a byte-level tokenizer file, without added special tokens.

    Its reserved string within a text is one id there, and so it is here. Texts on
    which the faster matcher gives up (very long white space) go to the library itself.
    """
    special = {t["content"]: t["id"] for t in _added(data)}
    enc = encoding(data, special)
    try:
        if any(s in text for s in special):
            return enc.encode(text, allowed_special="all")
        return enc.encode_ordinary(text)
    except BaseException as e:  # the matcher's panic isn't an Exception, and its type can't be imported
        if (type(e).__module__, type(e).__name__) != PANIC:
            raise
        return _library(data).encode(text, add_special_tokens=False).ids


def _added(data: bytes) -> list[dict]:
    key = ("added", _digest(data))
    if key not in _built:
        _built[key] = json.loads(data).get("added_tokens", [])
    return _built[key]


def _library(data: bytes):
    from tokenizers import Tokenizer

    key = ("library", _digest(data))
    if key not in _built:
        _built[key] = Tokenizer.from_str(data.decode())
    return _built[key]


def plain_library(data: bytes):
    """The library's tokenizer, for which strings of reserved entries within a text are plain text."""
    from tokenizers import Tokenizer

    key = ("plain library", _digest(data))
    if key not in _built:
        _built[key] = Tokenizer.from_str(data.decode())
        _built[key].encode_special_tokens = True
    return _built[key]
