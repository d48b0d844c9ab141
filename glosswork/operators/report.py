"""Reports and regression checks over small results."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows at most; the results themselves are tables.
MOST_ROWS = 500


def _cell(value) -> str:
    if value is None:
        return "–"
    if isinstance(value, float):
        return f"{value:.4f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, *order: str) -> str:
    """A Markdown table of a small result, in a stated order."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect() if order else df.limit(MOST_ROWS + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows[:MOST_ROWS]]
    return "\n".join(lines + (["", f"Only the first {MOST_ROWS} rows are shown."] if len(rows) > MOST_ROWS else []))


def metrics_report(title: str, totals: DataFrame, per_query: DataFrame) -> str:
    """Measures over all queries, then each query's; all numbers come from the tables."""
    t = totals.first().asDict()
    lines = [f"# {title}", ""]
    lines += [f"- hit@{k[3:]}: {v} of {t['queries']}" for k, v in t.items() if k.startswith("hit")]
    lines += [f"- {k}: {_cell(v)}" for k, v in t.items() if not k.startswith("hit")]
    return "\n".join([*lines, "", "## Queries", "", table(per_query, "query_id")])


def guard_report(title: str, versions: dict[str, DataFrame]) -> str:
    """Counts of each version of a guard (``lexicon.confusion``) side by side, with shares; a share of nothing is a dash."""
    found = {name: df.first().asDict() for name, df in versions.items()}
    share = lambda a, b: f"{a}/{b} ({a / b:.1%})" if b else "–"
    rows = {"blocked outside the corpus": ("block_count", "block_total"), "false positives": ("false_positives", "fixture_total"), "true positives": ("true_positives", "fixture_total")}
    lines = [f"# {title}", "", "| | " + " | ".join(found) + " |", "|" + "---|" * (len(found) + 1)]
    return "\n".join(lines + ["| " + " | ".join([name, *(share(f[a], f[b]) for f in found.values())]) + " |" for name, (a, b) in rows.items()])


def gate_report(title: str, agreements: dict[str, DataFrame]) -> str:
    """Agreement of each gate signal (``evaluate.agreement``) with what was expected, against the majority's."""
    lines = [f"# {title}", "", "| signal | agreed | majority | beats it |", "|---|---|---|---|"]
    for name, df in agreements.items():
        r = df.first()
        lines.append(f"| {name} | {r['agreed']}/{r['fixtures']} | {r['majority_baseline']}/{r['fixtures']} | {'yes' if r['agreed'] > r['majority_baseline'] else 'no'} |")
    return "\n".join(lines)


def write_prompts(prompts: DataFrame, folder: str) -> None:
    """Prompts (query_id, prompt) as a bundle: JSON lines under ``bundle`` and a text file in a folder for each query under ``files``."""
    prompts.select("query_id", "prompt").write.mode("overwrite").json(f"{folder}/bundle")
    prompts.select("query_id", "prompt").repartition("query_id").write.mode("overwrite").partitionBy("query_id").option("lineSep", "\n").text(f"{folder}/files")


def drifted(totals: DataFrame, expected: dict[str, float], tolerance: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Measures that differ from what is expected by more than the tolerance: name -> (found, expected)."""
    found = totals.first().asDict()
    return {k: (found[k], v) for k, v in expected.items() if abs(found[k] - v) > tolerance}
