"""Extraction with checks and retries, reports and drift."""

import json

from glosswork.operators import extract as xt
from glosswork.operators import report

GOOD = {"entities": [{"name": "a", "type": "t", "evidence": "x  y", "confidence": "high"}], "relations": []}


def broken(spark, payload, text="say x y"):
    raw = payload if isinstance(payload, str) else json.dumps(payload)
    rows = spark.createDataFrame([(1, text, raw)], "chunk_id int, text string, raw string")
    return sorted(r.rule for r in xt.violations(rows, ["t"], ["r"]).collect())


def change(part, **values):
    out = json.loads(json.dumps(GOOD))
    if part == "relations":
        out["relations"] = [{"source": "a", "target": "a", "type": "r", "evidence": "x y", "confidence": "low"} | values]
    else:
        out["entities"][0].update(values)
    return out


def test_rules(spark):
    assert broken(spark, GOOD) == []
    assert broken(spark, "```json\n" + json.dumps(GOOD) + "\n```") == []
    assert broken(spark, "nothing") == ["not an object of entities and relations"]
    assert broken(spark, {"entities": []}) == ["not an object of entities and relations"]
    assert broken(spark, change("entities", type="odd")) == ["unknown entity type"]
    assert broken(spark, change("entities", confidence=None)) == ["unknown confidence"]
    assert broken(spark, change("entities", evidence="not there")) == ["evidence not in the text"]
    assert broken(spark, change("entities", name="")) == ["entity without a name"]
    assert broken(spark, change("relations")) == []
    assert broken(spark, change("relations", target="b")) == ["relation end is no entity"]
    assert broken(spark, change("relations", type="odd")) == ["unknown relation type"]


def test_one_retry_then_quarantine(spark):
    def client(prompt, attempt):
        text = prompt.split("\n\n", 1)[1]
        if text == "late" and attempt == 1 or text == "never":
            return "nothing"
        return json.dumps({"entities": [{"name": "e", "type": "t", "evidence": text, "confidence": "low"}], "relations": []})

    chunks = spark.createDataFrame([(1, "fine"), (2, "late"), (3, "never")], "chunk_id int, text string")
    good, bad, tallies = xt.extract(chunks, client, ["t"], ["r"])
    assert {r.chunk_id: r.attempt for r in good.collect()} == {1: 1, 2: 2}
    assert [(r.chunk_id, len(r.rules)) for r in bad.collect()] == [(3, 1)]
    assert {r.attempt: r.calls for r in tallies.collect()} == {1: 3, 2: 2}


def test_report(spark):
    totals = spark.createDataFrame([(2, 1, 0.75)], "queries int, hit1 int, mrr double")
    rows = spark.createDataFrame([(2, "x|y", None), (1, "z", 0.5)], "query_id int, note string, score double")
    text = report.metrics_report("Run", totals, rows)
    assert "- hit@1: 1 of 2" in text and "- mrr: 0.7500" in text
    assert text.endswith("| 1 | z | 0.5000 |\n| 2 | x\\|y | – |")
    assert report.drifted(totals, {"mrr": 0.75, "hit1": 2}) == {"hit1": (1, 2)}


def test_guard_and_gate_reports(spark):
    one = spark.createDataFrame([(4, 1, 0, 0, 0)], "block_total long, block_count long, fixture_total long, false_positives long, true_positives long")
    text = report.guard_report("Guard", {"v1": one, "v2": one})
    assert "| blocked outside the corpus | 1/4 (25.0%) | 1/4 (25.0%) |" in text and "| false positives | – | – |" in text
    gate = spark.createDataFrame([(9, 7, 6)], "fixtures long, agreed long, majority_baseline long")
    assert "| gap | 7/9 | 6/9 | yes |" in report.gate_report("Gate", {"gap": gate})


def test_prompt_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "query_id long, prompt string")
    report.write_prompts(df, str(tmp_path))
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/bundle").select("query_id", "prompt").collect())) == [(1, "a\nb"), (2, "c")]
    assert {p.read_text() for p in (tmp_path / "files" / "query_id=1").glob("part-*.txt")} == {"a\nb\n"}
