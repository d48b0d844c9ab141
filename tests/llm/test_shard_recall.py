"""Recall of full shards of the graph search against brute force, where a search meets a small part of a shard."""

from pathlib import Path

import numpy as np
import pyarrow.dataset as ds
import pytest

from glosswork.llm import ann

TABLE = Path("/root/testdata/check_l/embeddings.parquet")


def recall(x):
    """Share of the true 20 nearest found, and the share of a shard that a beam can hold."""
    edges, entry = ann.build_graph(ann.equal_norm(x))
    asked, hits = np.arange(0, len(x), 20), 0
    for i in range(0, len(asked), 256):
        at = asked[i : i + 256]
        score = x[at].astype(float) @ x.T.astype(float)
        score[np.arange(len(at)), at] = -np.inf
        want = np.argpartition(-score, 20, axis=1)[:, :20]
        found, _ = ann.beam_search(x, edges, entry, x[at], ann.SEARCH_BEAM)
        for j, q in enumerate(at):
            near = found[j][(found[j] >= 0) & (found[j] != q)]
            hits += len(set(near[np.argsort(-score[j, near])][:20].tolist()) & set(want[j].tolist()))
    return hits / 20 / len(asked)


@pytest.mark.skipif(not TABLE.exists(), reason="no table that fills a shard")
def test_recall_of_a_full_shard():
    x = np.unique(np.array(ds.dataset(TABLE).to_table(columns=["embedding"]).column("embedding").to_pylist(), np.float32), axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))][: ann.SHARD_VECTORS]
    assert len(x) == ann.SHARD_VECTORS >= 20 * ann.SEARCH_BEAM
    assert recall(x) >= 0.98


def test_recall_of_a_full_shard_of_normal_vectors():
    """A hard case: nothing is near to anything, so a graph has little to follow."""
    assert recall(np.random.default_rng(2).standard_normal((ann.SHARD_VECTORS, 64)).astype(np.float32)) >= 0.9
