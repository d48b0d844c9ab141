"""Answer records, gold given as data, keywords in what was found, and every number that stands in a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as tx
from glosswork.operators import answer as an
from glosswork.operators import evaluate as ev
from glosswork.operators import lexical
from glosswork.operators import lexicon as lx
from glosswork.operators import vectors as vec
from glosswork.operators import versions as vs
from glosswork.operators.durable import written
from glosswork.plans import curation as cn
from glosswork.plans import retrieval as rt
from glosswork.plans.text import _SENT, ALLOWED, MARKERS, TERMS, _docs, _list, _match, sentences
from glosswork.sources.tables import table

#: Gap of scores from which the gate passes, so that the second net is asked too.
GATE = 0.4
#: What is looked for among the documents that were found.
KEYWORDS = ["trash", "password", "zzz", "the ", "token"]
#: A number as a person may write it.
NUMBER = r"\d{3,4}[- ]?\d{4,}"


def _say(prompt: F.Column) -> F.Column:
    """Stands in for a model: repeats the end of what it was asked."""
    return F.concat(F.lit("Sources say: "), F.expr("right(prompt, 200)"))


def answer_records(spark: SparkSession, d: str) -> DataFrame:
    """A record of every question, answered by a stand-in client, shared words being the second net."""
    hits = written(rt._found(spark, d))  # one search for band, gate and ranks
    stats = vec.score_statistics(hits)
    gated = written(ev.band(stats, 0.36, 0.42).select("query_id", "band", "score_gap").join(ev.gate(stats, "score_gap", GATE).select("query_id", "verdict"), "query_id"))
    docs = _docs(spark, d)
    questions = gated.join(docs.select(F.col("doc_id").alias("query_id"), tx.squash(F.col("text")).alias("question"), F.col("text").alias("guarded")), "query_id")
    one = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("document "), "doc_id").alias("header"), "text", (F.col("lang") != "de").alias("citable"))
    found = lambda ranks: ranks.join(one, "id").select("query_id", F.col("rank").alias("ordinal"), F.col("id").alias("chunk_id"), "header", "text", "citable")
    words, rows = cn._long_words(spark, d)
    words = words.join(gated.where("verdict = 'PASS' and band != 'refuse'").select("query_id"), "query_id", "left_semi")  # the second net is used for no other
    vector, second = found(vec.ranking(hits)), found(lexical.top_shared(words, rows, 3))
    out = an.records(questions, vector, second, an.column_client(_say), lx.load_terms(TERMS), MARKERS, ALLOWED, cn.PROFILE)
    ids = F.array_join(F.col("evidence").cast("array<string>"), "|")
    return out.select("query_id", "band", "status", "gate_verdict", ids.alias("evidence"), F.sha2("answer", 256).alias("answer_sha256"), F.col("guard.blocked").alias("output_blocked"), F.array_join("guard.matched_terms", "|").alias("matched_terms"))


def gold_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Gold given as data: labelled good documents of 200 characters or more, for the question of their hundred; label 3 is marked as missing."""
    gold = table(spark, d, "labels").where("quality = 1").select((F.col("doc_id") - F.col("doc_id") % 100).alias("query_id"), F.col("doc_id").alias("chunk_id"))
    queries = rt._queries(spark, d).select("query_id", F.when(F.col("label") == 3, "missing").when(F.col("label") == 4, "partial").alias("coverage"))
    return ev.gold_coverage(queries, gold, _docs(spark, d).where("n_chars >= 200").select(F.col("doc_id").alias("chunk_id")))


def keyword_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each keyword among the top 5 of each query, and what its absence means."""
    found = vec.ranking(rt._found(spark, d)).select("query_id", "rank", "id")
    return ev.keyword_presence(found, rt._queries(spark, d).select("query_id"), _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), KEYWORDS)


def numeric_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every number in every sentence, with how many sentences of the document have one."""
    hits = sentences(_docs(spark, d)).select("doc_id", "pos", F.posexplode(F.regexp_extract_all("sentence", F.lit(f"({NUMBER})"), 1)).alias("hit", "number"))
    return hits.select("doc_id", "pos", (F.col("hit") + 1).cast("long").alias("hit"), "number")


def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences and documents hold a number, of each language, and of all."""
    s = sentences(_docs(spark, d), "lang").where(F.col("sentence").rlike(NUMBER))
    per = s.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("lang").agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("documents"))


def nearest_word(spark: SparkSession, d: str) -> DataFrame:
    """For each word of the benchmark that no document has, the nearest of the words that five documents or more have."""
    plain = lambda df: df.select(F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("word")).where(F.col("word").rlike("^[a-z]{3,12}$"))
    counted = plain(_docs(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    unknown = plain(table(spark, d, "benchmark")).distinct().join(counted, "word", "left_anti")
    return lx.nearest(unknown, counted.where("n >= 5").select(F.col("word").alias("term")))


def corpus_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two versions of the documents: some are new, some lost, and of some the language or the text is another."""
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    old = docs.where("doc_id % 97 != 3")
    text = F.when(F.col("doc_id") % 89 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    new = docs.where("doc_id % 83 != 7").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 101 == 9, None).otherwise(F.col("lang")).alias("lang"))
    found = vs.changes(*[vs.rows_of(v, "doc_id", ["text", "lang"]) for v in (old, new)])
    return found.withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (answer_records, gold_exceptions, keyword_ranks, numeric_hits, numeric_summary, nearest_word, corpus_changes)}

_E = "e AS (SELECT r.query_id, r.rank, d.lang <> 'de' AS citable, 'document ' || d.doc_id AS header, d.text, d.doc_id AS chunk_id FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 5)"
_BOTH = f"""{cn._LEX}, t5 AS (SELECT query_id, rank, vec_id AS id FROM r WHERE rank <= 5),
l3 AS (SELECT query_id, 1000000 + rank AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM lx) x WHERE rank <= 3 AND query_id IN (SELECT query_id FROM st WHERE score_gap >= {GATE}) AND NOT EXISTS (SELECT 1 FROM t5 WHERE t5.query_id = x.query_id AND t5.id = x.id)),
e AS (SELECT z.query_id, z.rank, d.lang <> 'de' AS citable, 'document ' || d.doc_id AS header, d.text, d.doc_id AS chunk_id FROM (SELECT * FROM t5 UNION ALL SELECT * FROM l3) z JOIN documents d ON d.doc_id = z.id)"""
assert _E in cn._PROMPT
_LONG = sorted(TERMS, key=lambda t: -len(t))
ORACLES = {
    "answer_records": f"""{cn._PROMPT.replace(_E, _BOTH)}, ua AS (SELECT p.query_id, band, CASE WHEN band = 'refuse' THEN 'refused' WHEN blocked THEN 'blocked' ELSE 'answered' END AS status, score_gap, 'Sources say: ' || right(prompt, 200) AS said FROM p JOIN st ON st.query_id = p.query_id),
        ga AS (SELECT *, {_match('said', _LONG)} AS hits, {_match('said', MARKERS)} AS marks, {_match('said', ALLOWED)} AS free FROM ua),
        ha AS (SELECT *, len(hits) > 0 AND NOT (len(free) > 0 AND len(marks) = 0) AS named FROM ga),
        ids AS (SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank) AS ids FROM e GROUP BY query_id)
        SELECT h.query_id, band, status, CASE WHEN status = 'answered' THEN CASE WHEN score_gap >= {GATE} THEN 'PASS' ELSE 'REFUSE' END END AS gate_verdict, CASE WHEN status = 'answered' THEN ids END AS evidence,
          sha256(CASE status WHEN 'answered' THEN CASE WHEN named AND len(marks) > 0 THEN '{lx.REFUSAL}' WHEN named THEN said || '{lx.DISCLAIMER}' ELSE said END WHEN 'blocked' THEN '{lx.REFUSAL}' END) AS answer_sha256,
          CASE status WHEN 'answered' THEN named AND len(marks) > 0 WHEN 'blocked' THEN FALSE END AS output_blocked, CASE status WHEN 'answered' THEN array_to_string(hits, '|') WHEN 'blocked' THEN '' END AS matched_terms FROM ha h LEFT JOIN ids ON ids.query_id = h.query_id""",
    "gold_exceptions": f"""WITH {rt._Q}, g AS (SELECT l.doc_id - l.doc_id % 100 AS query_id, count(DISTINCT l.doc_id) AS refs, count(DISTINCT CASE WHEN n_chars >= 200 THEN l.doc_id END) AS gold FROM labels l LEFT JOIN documents d USING (doc_id) WHERE quality = 1 GROUP BY 1),
        c AS (SELECT q.query_id, CASE label WHEN 3 THEN 'missing' WHEN 4 THEN 'partial' END AS coverage, coalesce(refs, 0) AS refs, coalesce(gold, 0) AS gold FROM q LEFT JOIN g USING (query_id))
        SELECT *, CASE WHEN gold > 0 THEN 'gold' WHEN coverage = 'missing' THEN 'none expected' ELSE 'error' END AS verdict FROM c""",
    "keyword_ranks": f"""{rt._BASE}, k AS (SELECT unnest({_list(*KEYWORDS)}) AS word), n AS (SELECT word, count(*) FILTER (WHERE contains(text, word)) AS in_corpus FROM k, documents GROUP BY word),
        h AS (SELECT r.query_id, word, string_agg(rank, '|' ORDER BY rank) AS ranks FROM r JOIN documents d ON d.doc_id = r.vec_id JOIN k ON contains(d.text, word) WHERE rank <= 5 GROUP BY ALL)
        SELECT q.query_id, n.word, coalesce(ranks, '') AS ranks, in_corpus, CASE WHEN ranks IS NOT NULL THEN 'found' WHEN in_corpus > 0 THEN 'ranking' ELSE 'collection' END AS verdict FROM q CROSS JOIN n LEFT JOIN h ON h.query_id = q.query_id AND h.word = n.word""",
    "numeric_hits": rf"""WITH {_SENT}, x AS (SELECT doc_id, pos, regexp_extract_all(sentence, '{NUMBER}') AS l FROM s) SELECT doc_id, pos, CAST(hit AS BIGINT) AS hit, l[hit] AS number FROM (SELECT *, unnest(range(1, len(l) + 1)) AS hit FROM x)""",
    "nearest_word": rf"""WITH a AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]{{3,12}}') GROUP BY word),
        b AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark) WHERE regexp_full_match(word, '[a-z]{{3,12}}') AND word NOT IN (SELECT word FROM a)),
        x AS (SELECT b.word, a.word AS term, CAST(levenshtein(b.word, a.word) AS INTEGER) AS distance FROM b JOIN a ON abs(length(a.word) - length(b.word)) <= 2 AND n >= 5)
        SELECT word, term, distance FROM x WHERE distance <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, term) = 1""",
    "corpus_changes": """SELECT doc_id, CASE WHEN doc_id % 97 = 3 THEN 'added' WHEN doc_id % 83 = 7 THEN 'removed' ELSE 'changed' END AS change FROM documents
        WHERE (doc_id % 97 = 3) <> (doc_id % 83 = 7) OR (doc_id % 97 <> 3 AND doc_id % 83 <> 7 AND (doc_id % 89 = 5 OR (doc_id % 101 = 9 AND lang IS NOT NULL)))""",
    "numeric_summary": rf"WITH {_SENT} SELECT lang, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM s JOIN documents USING (doc_id) WHERE regexp_matches(sentence, '{NUMBER}') GROUP BY lang",
}
