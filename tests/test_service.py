"""A paged service as a data source, with a client that counts, fails and ends."""

import os

import pytest

from glosswork.sources import service as sv


@pytest.mark.parametrize("pages", [0, 1, 2, 3, 7, 8, 9, 1000])
@pytest.mark.parametrize("most", [0, 1, 5, 1 << 20])
def test_count_pages(pages, most):
    calls = []

    def fetch(page):
        calls.append(page)
        return [(page,)] if page < pages else []

    assert sv.count_pages(fetch, most) == min(pages, most)
    assert len(calls) <= 2 + 2 * min(pages, most).bit_length() and all(c < max(most, 1) for c in calls)


def client(folder, pages, size, failing=()):
    """Serves numbered rows; each page of ``failing`` fails at its first call."""

    def fetch(page):
        mark = os.path.join(folder, f"{page}")
        if page in failing and not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("busy")
        return [(page * size + i, f"item {page * size + i}") for i in range(size if page < pages - 1 else size - 2)] if page < pages else []

    return fetch


def test_reads_all_pages_and_tries_again(spark, tmp_path):
    sv.register(spark, "items", client(str(tmp_path), 9, 50, failing=(0, 3, 8)), "id long, title string")
    df = spark.read.format("items").option("pagesPerTask", 2).option("pause", 0.01).load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == [(i, f"item {i}") for i in range(448)]
    assert spark.read.format("items").option("pages", 3).load().count() == 150
    assert df.where("id = 60").select("title").first()[0] == "item 60"


def test_no_pages_and_lasting_failure(spark, tmp_path):
    sv.register(spark, "nothing", client(str(tmp_path), 0, 5), "id long, title string")
    assert spark.read.format("nothing").load().count() == 0

    def broken(page):
        raise ConnectionError("gone")

    sv.register(spark, "broken", broken, "id long")
    with pytest.raises(Exception, match="page 0 failed 2 times"):
        spark.read.format("broken").option("attempts", 2).option("pause", 0).load().collect()
