"""Joins, merges, checks, samples and records over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.functions import text as tx
from glosswork.operators import curate as cu
from glosswork.operators import evaluate as ev
from glosswork.operators import extract as xt
from glosswork.operators import lexical
from glosswork.operators import lexicon as lx
from glosswork.operators import sampling as sa
from glosswork.operators import validate as va
from glosswork.operators import vectors as vec
from glosswork.operators.durable import shared_folder, written
from glosswork.plans import retrieval as rt
from glosswork.plans.text import _SENT, ALLOWED, TERMS, _docs, _match, sentences
from glosswork.sources import files
from glosswork.sources.tables import table

SEED = 7
#: Who the prompts are written for.
PROFILE = "level: new to the subject"


def scan_chunks(spark, d):
    """Documents as typed chunks in (source, id) order; they have no timeline."""
    return files.forbid_columns(_docs(spark, d), ["start_ms", "end_ms", "segment_index"]).select("source", "doc_id", F.length("text").cast("long").alias("chars"), "n_chars").orderBy("source", "doc_id")


def scan_jsonl(spark, d):
    """Documents through JSON lines and back."""
    import uuid

    docs = _docs(spark, d).select("doc_id", "text", "lang")
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(docs, path)
    return files.read_jsonl(spark, path, docs.schema).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


def scan_csv(spark, d):
    """Customers through CSV and back."""
    import uuid

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(table(spark, d, "customer"), path, ["c_custkey", "c_name"])
    return files.read_csv(spark, path, ["c_custkey", "c_name"])


def scan_tsv(spark, d):
    """Suppliers through a tab-separated index and back."""
    import uuid

    path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    table(spark, d, "supplier").select(F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey")).write.text(path)
    return files.read_tsv(spark, path, "s_suppkey long, s_name string, s_nationkey int")


def scan_records(spark, d):
    """Benchmark items through JSON documents with an array of records each, and back."""
    import uuid

    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    grouped = table(spark, d, "benchmark").groupBy(F.expr("item_id div 10").alias("g")).agg(F.collect_list(F.struct("item_id", "text")).alias("queries"))
    one = grouped.select("g", F.to_json(F.struct(F.lit("v1").alias("version"), "queries")).alias("value"))
    one.repartition(4, "g").write.partitionBy("g").text(path)
    return files.read_records(spark, path, "queries", "item_id bigint, text string").select("item_id", F.sha2("text", 256).alias("text_sha256"))


def vtt_parse(spark, d):
    """Captions made of conversations and parsed again."""
    line = F.concat(tx.ms_to_clock(F.col("turn") * 2000), F.lit(" --> "), tx.ms_to_clock(F.col("turn") * 2000 + 1500), F.lit("\n<b>"), F.regexp_replace("text", "\n+", " "), F.lit("</b>\n\n"))
    made = table(spark, d, "conversations").select("conv_id", "turn", line.alias("l")).groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]), "")).alias("text"))
    return files.parse_captions(made)


def approved_ids(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()


def metadata_semi(spark, d):
    """Customers among the approved ids."""
    return table(spark, d, "customer").select("c_custkey", "c_name").join(approved_ids(spark, d), F.col("c_custkey") == F.col("id"), "left_semi")


def semi_anti(spark, d):
    """Customers with and without an order, by segment."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    some = c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("has_order"))
    return some.unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("has_order")))


def set_difference(spark, d):
    """Parts that no large returned line item has."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return p.exceptAll(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 46").select(F.col("l_partkey").alias("id")).distinct())


def keep_last(spark, d):
    """The last line of each order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return cu.keep(li, ["l_orderkey"], -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))


def dedupe_question(spark, d):
    """The first document of each text, white space and case aside."""
    docs = _docs(spark, d).withColumn("question", F.lower(F.regexp_replace("text", r"\s+", ""))).select("question", "doc_id", "lang")
    return cu.keep(docs, ["question"], F.col("doc_id")).select("doc_id", "lang")


def coalesce_fields(spark, d):
    """The first of several fields that is filled."""
    return _docs(spark, d).select("doc_id", files.first_filled(F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")), F.when(F.col("n_chars") > 1000, F.col("source")), F.lit("none")).alias("value"))


def systematic_sample(spark, d):
    return sa.systematic(_docs(spark, d).select("doc_id", "lang"), "doc_id", 50)


def seeded_sample(spark, d):
    return sa.simple(_docs(spark, d).select("doc_id", "lang"), "doc_id", 50, SEED)


def stratified_sample(spark, d):
    return sa.stratified(_docs(spark, d).select("doc_id", "source"), "doc_id", ["source"], 90, SEED)


def stratified_two_level(spark, d):
    return sa.stratified(_docs(spark, d).select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], 90, SEED)


def batch_ids(spark, d):
    """Batches of 50 customers of a nation, in key order; numbered by ranges, so that no task holds a nation."""
    numbered = sa.number(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")
    first = numbered.groupBy("c_nationkey").agg(F.min("row_number").alias("first"))
    return numbered.join(first, "c_nationkey").select("c_custkey", "c_nationkey", F.expr("(row_number - first) div 50").alias("batch"))


def eligible_filter(spark, d):
    return _docs(spark, d).where("n_chars >= 200").select("doc_id", "n_chars")


def split_filter(spark, d):
    """Approved orders of one split, or of all."""
    return table(spark, d, "orders").where("o_orderstatus = 'F' and (o_orderpriority = '1-URGENT' or o_orderpriority = '5-LOW')").select("o_orderkey", "o_orderpriority")


def chunk_header(spark, d):
    """Headers over the union of pages and documents."""
    u = corpus_union(spark, d)
    head = F.when(F.col("source_kind") == "page", F.concat(F.lit("page "), "id", F.lit(" "), "url")).otherwise(F.concat(F.lit("document "), "id", F.lit(" ("), "lang", F.lit(")")))
    return u.select("source_kind", "id", head.alias("header"))


def corpus_union(spark, d):
    """Pages and documents as one corpus; what a kind lacks is null."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.lit("page").alias("source_kind"))
    return pages.unionByName(_docs(spark, d).select(F.col("doc_id").alias("id"), "lang", F.lit("document").alias("source_kind")), allowMissingColumns=True)


def prefix_resolve(spark, d):
    """Each prefix of three digits of an item's address with the documents' addresses it matches; just one is right."""
    ids = _docs(spark, d).select(F.sha2(F.col("doc_id").cast("string"), 256).alias("full")).withColumn("prefix", F.left("full", F.lit(3)))
    want = table(spark, d, "benchmark").select(F.left(F.sha2(F.col("item_id").cast("string"), 256), F.lit(3)).alias("prefix")).distinct()
    found = want.join(ids, "prefix", "left").groupBy("prefix").agg(F.count("full").alias("matches"))
    return found.withColumn("status", F.when(F.col("matches") == 1, "ok").when(F.col("matches") == 0, "unknown").otherwise("ambiguous"))


def validate_rows(spark, d):
    c = F.col
    return va.rows(table(spark, d, "customer"), "c_custkey", {"negative balance": c("c_acctbal") < 0, "odd segment": ~c("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY"), "empty name": c("c_name").isNull() | (c("c_name") == ""), "nation out of range": ~c("c_nationkey").between(0, 23)})


def validate_unique(spark, d):
    return va.unique(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def validate_single_config(spark, d):
    docs = _docs(spark, d).withColumn("setting", F.when(F.col("n_chars") > 300, F.lit("v2")))
    return va.single_setting(docs, "source", "lang", "setting")


def incremental_plan(spark, d):
    """skip, normalise or fetch, by what is there already."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(o_orderstatus = 'F')").alias("done"))
    joined = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("n").isNull(), "fetch").when(F.col("done") > 0, "skip").otherwise("normalise").alias("action"))


def grounding_check(spark, d):
    """Whether each item stands in a document, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    items = table(spark, d, "benchmark").select("item_id", bare("text").alias("term"))
    hits = lx.term_hits(_docs(spark, d).select(F.col("doc_id").alias("id"), bare("text").alias("text")), items.select("term"))
    return items.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("documents"), F.col("n").isNotNull().alias("grounded"))


def hash_join_lookup(spark, d):
    """Line items with brand and nation looked up, summed."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p, s, n = table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return joined.groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


def anchor_join(spark, d):
    """Quotes claimed for documents, the odd ones for the document after: contained, missing or too short."""
    docs = _docs(spark, d)
    anchors = docs.select((F.col("doc_id") + F.col("doc_id") % 2).alias("claimed"), F.col("doc_id").alias("anchor_id"), F.substring("text", 11, 30).alias("quote"))
    joined = anchors.join(docs.select(F.col("doc_id").alias("claimed"), "text"), "claimed", "left")
    status = F.when(F.length("quote") < 20, "short").when(F.col("text").isNull(), "unknown document").when(F.contains("text", "quote"), "found").otherwise("missing")
    return joined.select("anchor_id", "claimed", status.alias("status"))


def ledger_merge(spark, d):
    """A ledger of customers with orders, refreshed from the customer table; building customers that are new come in."""
    ledger = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("title"), F.lit("OLD").alias("classification"), F.col("o_orderstatus").alias("review_status"), F.lit("seen").alias("review_reason"))
    ledger = cu.keep(ledger, ["id"], F.col("o_orderkey")).drop("o_orderkey")
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("classification"))
    return cu.ledger_merge(ledger, meta, "id", ["title", "classification"], {"review_status": "PENDING", "review_reason": ""}, F.col("classification") == "BUILDING")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a query for each ten conversations: all their turns, in order."""
    query, turn = F.expr("conv_id div 10").alias("query_id"), F.col("conv_id") * 1000 + F.col("turn")
    t = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    return t.select(query, turn.alias("rank"), turn.alias("chunk_id"), F.col("conv_id").alias("qa_id"), (F.col("role") == "user").alias("is_question"))


def qa_siblings(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("qa_id"), F.col("turn").alias("chunk_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"))
    return cu.expand_siblings(_evidence(spark, d), answers, cap=2)


def ordered_distinct(spark, d):
    o = table(spark, d, "orders")
    return cu.ordered_distinct(o, "o_custkey", ["o_orderkey"], "o_orderpriority").select("o_custkey", F.array_join("values", "|").alias("priorities"))


def corpus_fingerprint(spark, d):
    return cu.fingerprint(_docs(spark, d), "doc_id", "text")


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    return vec.ranking(vec.search(rt._queries(spark, d), rt._corpus(spark, d), k))


def _long_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct words of five letters or more, of the query set's documents and of all."""
    words = F.filter(F.array_distinct(tx.words(F.lower("text"))), lambda w: F.length(w) >= 5)
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    asked = rt._queries(spark, d).select("query_id").join(docs, F.col("query_id") == F.col("id"))  # texts are split after the join: only those that ask
    return asked.select("query_id", words.alias("words")), docs.select("id", words.alias("words"))


def two_net_pool(spark, d):
    """The top 20 by vector, and the top 10 by shared words that aren't among them."""
    dense = _ranked(spark, d, 20)
    rest = lexical.top_shared(*_long_words(spark, d), 30).join(dense, ["query_id", "id"], "left_anti")  # 20 of 30 may be known, 10 are left
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = rest.withColumn("rank", rank.cast("long")).where("rank <= 10").select("query_id", F.lit("lexical").alias("net"), "rank", "id")
    return dense.select("query_id", F.lit("vector").alias("net"), "rank", "id").unionByName(found)


def hybrid_merge(spark, d):
    """The top 5 by vector, then the top 10 by shared words, each id once."""
    return cu.ordered_merge(_ranked(spark, d, 5).select("query_id", "rank", "id"), lexical.top_shared(*_long_words(spark, d), 10).select("query_id", "rank", "id"))


def gold_union(spark, d):
    """Relevant ids by label of the first span, and by shared words."""
    a = rt._gold(spark, d).where("span_id = 0").select("query_id", "id")
    return a.union(lexical.sharing(*_long_words(spark, d), 12).select("query_id", "id")).distinct()


def hash_encode(spark, d):
    """Hashed embeddings of the benchmark items as queries and of the documents as passages; tests hold them against a plain version."""
    part = lambda df, key, role: vec.hash_encode(df.select(F.col(key).alias("id"), "text"), 32, role).select(F.lit(role).alias("role"), "id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).cast("string").alias("embedding"))
    return part(table(spark, d, "benchmark"), "item_id", "query").unionByName(part(_docs(spark, d), "doc_id", "passage"))


def _prompt_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stats = ev.band(vec.score_statistics(vec.search(rt._queries(spark, d), rt._corpus(spark, d), 5)), 0.36, 0.42)
    docs = _docs(spark, d)
    questions = stats.select("query_id", "band").join(docs.select(F.col("doc_id").alias("query_id"), tx.squash(F.col("text")).alias("question"), F.col("text").alias("full")), "query_id")
    found = _ranked(spark, d, 5).join(docs.select(F.col("doc_id").alias("id"), "text", "source", "lang"), "id")
    evidence = found.select("query_id", F.col("rank").alias("ordinal"), F.col("id").alias("chunk_id"), F.concat(F.lit("document "), "id").alias("header"), "text", (F.col("lang") != "de").alias("citable"))
    return questions, evidence


def prompt_render(spark, d):
    questions, evidence = _prompt_parts(spark, d)
    return cu.prompts(questions.select("query_id", "question", "band"), evidence, PROFILE)


def prompt_citations(spark, d):
    """Which document each number of the prompts stands for."""
    return cu.citations(_prompt_parts(spark, d)[1])


def answer_pipeline(spark, d):
    """Records without a model: refused by band, blocked by the guard, or the prompt's digest."""
    questions, evidence = _prompt_parts(spark, d)
    guarded = questions.withColumn("blocked", lx.guard_input(F.col("full"), lx.load_terms(TERMS), ALLOWED)["blocked"])
    asked = guarded.where("band != 'refuse' and not blocked")
    prompt = cu.prompts(asked.select("query_id", "question", "band"), evidence.join(asked.select("query_id"), "query_id", "left_semi"), PROFILE)
    joined = guarded.join(prompt, "query_id", "left")
    status = F.when(F.col("band") == "refuse", "refused").when(F.col("blocked"), "blocked").otherwise("prompted")
    return joined.select("query_id", "band", status.alias("status"), F.when(status != "prompted", F.lit(lx.REFUSAL)).alias("answer"), F.sha2("prompt", 256).alias("prompt_sha256"))


def backfill_merge(spark, d):
    """Answers for every second document and some unknown ones, filled into records of all documents."""
    docs = _docs(spark, d)
    records = docs.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 10 == 4, "v1").otherwise("v2").alias("prompt_version"), F.when(F.col("n_chars") < 300, "refuse").otherwise("answer").alias("band"), F.when(F.col("lang") == "de", F.col("source")).alias("answer"), (F.col("doc_id") % 4 != 1).alias("generated"))
    answers = docs.where("doc_id % 2 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 100 == 50, 1_000_000_000).otherwise(0)).alias("query_id"), F.concat(F.lit("answer "), "doc_id").alias("text"))
    return cu.backfill(records, answers, "v2")


def synthetic_build(spark, d):
    """Questions from all sentences, as a model might return them: skipped if empty, short or seen before, the rest numbered."""
    proposed = sentences(_docs(spark, d)).withColumnRenamed("sentence", "question")
    marked = written(cu.normalise_questions(proposed, ["doc_id", "pos"]))
    kept = sa.number(marked.where("reason is null").select("doc_id", "pos"), "doc_id", "pos")
    gone = marked.where("reason is not null").select("doc_id", "pos", F.lit(None).cast("string").alias("query_id"), F.col("reason").alias("outcome"))
    return kept.select("doc_id", "pos", F.format_string("s%06d", "row_number").alias("query_id"), F.lit("kept").alias("outcome")).unionByName(gone)


def label_import(spark, d):
    """Suggested labels against those there are; one violation holds all back."""
    own = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = _docs(spark, d).select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("suggestion"), F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("blocked"))
    joined = own.join(docs, "doc_id")
    gate = joined.agg(F.count_if("blocked").alias("violations"))
    return joined.crossJoin(F.broadcast(gate)).select("doc_id", "label", "suggestion", (F.col("label") != F.col("suggestion")).alias("differs"), "blocked", (F.col("violations") == 0).alias("imported"))


def flatten_props(spark, d):
    """Nested JSON flattened, with defaults for what is missing."""
    p = F.from_json("props", "struct<k: bigint, big: struct<url: string>, small: struct<url: string>>")
    e = table(spark, d, "events").withColumn("p", p)
    return e.select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.big.url", "p.small.url", F.lit("")).alias("thumbnail"), F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("tags"))


def _client(asked: str, attempt: int) -> str:
    """Stands in for a model: names the first two words; some first answers are no JSON, some never hold."""
    import json

    words = asked.split("\n\n", 1)[1].split()[:2]
    if len(words[0]) % 3 == 0 and attempt == 1:
        return "no JSON"
    evidence = "made up" if len(words[0]) % 7 == 0 else " ".join(words)
    entities = [{"name": w, "type": "word", "evidence": evidence, "confidence": "high"} for w in dict.fromkeys(words)]
    relations = [{"source": words[0], "target": words[-1], "type": "before", "evidence": evidence, "confidence": "low"}]
    return "```json\n" + json.dumps({"entities": entities, "relations": relations}) + "\n```"


def extraction_run(spark, d):
    """Extraction over the benchmark items by a stand-in client: records and what was set aside; rows only."""
    chunks = table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    good, quarantine, _ = xt.extract(chunks, _client, ["word"], ["before"])
    return good.select("chunk_id", "attempt", F.size("parsed.entities").alias("entities"), F.lit(None).cast("string").alias("rules")).unionByName(quarantine.select("chunk_id", F.lit(2).alias("attempt"), F.lit(0).alias("entities"), F.array_join("rules", "|").alias("rules")))


_WORDS5 = r"SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) >= 5))) AS word FROM documents"
_LEX = f"w AS ({_WORDS5}), lx AS (SELECT q.query_id, a.doc_id AS id, count(*) AS hits FROM q JOIN w b ON b.doc_id = q.query_id JOIN w a ON a.word = b.word AND a.doc_id <> q.query_id GROUP BY ALL)"
_FLAT = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_BLOCKED = f"len({_match('d.text', sorted(TERMS, key=lambda t: -len(t)))}) > 0 AND len({_match('d.text', ALLOWED)}) = 0"
_PROMPT = f"""{rt._BASE}, b AS (SELECT st.query_id, CASE WHEN score_gap < 0.36 THEN 'refuse' WHEN score_gap < 0.42 THEN 'hedge' ELSE 'answer' END AS band, {_FLAT.format(c='d.text')} AS question, {_BLOCKED} AS blocked FROM st JOIN documents d ON d.doc_id = st.query_id),
e AS (SELECT r.query_id, r.rank, d.lang <> 'de' AS citable, 'document ' || d.doc_id AS header, d.text, d.doc_id AS chunk_id FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, citable ORDER BY rank) AS n FROM e),
g AS (SELECT query_id, coalesce(string_agg('[' || n || '] ' || header || chr(10) || text, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE citable), '') AS s, coalesce(string_agg('(' || header || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE NOT citable), '') AS c FROM f GROUP BY query_id),
p AS (SELECT query_id, band, blocked, '{cu.RULES}' || CASE WHEN band = 'hedge' THEN chr(10) || '{cu.HEDGE_RULE}' ELSE '' END || CASE WHEN c <> '' THEN chr(10) || '{cu.CONTEXT_RULE}' ELSE '' END || chr(10) || chr(10) || 'Reader:' || chr(10) || '{PROFILE}' || chr(10) || chr(10) || 'Sources:' || chr(10) || s
  || CASE WHEN c <> '' THEN chr(10) || chr(10) || 'Cases:' || chr(10) || c ELSE '' END || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM b LEFT JOIN g USING (query_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        scan_chunks, scan_jsonl, scan_csv, scan_tsv, scan_records, vtt_parse, approved_ids, metadata_semi, semi_anti, set_difference, keep_last, dedupe_question, coalesce_fields, systematic_sample, seeded_sample, stratified_sample,
        stratified_two_level, batch_ids, eligible_filter, split_filter, chunk_header, corpus_union, prefix_resolve, validate_rows, validate_unique, validate_single_config, incremental_plan, grounding_check,
        hash_join_lookup, anchor_join, ledger_merge, qa_siblings, ordered_distinct, corpus_fingerprint, two_net_pool, hybrid_merge, gold_union, hash_encode, prompt_render, prompt_citations, answer_pipeline, backfill_merge,
        synthetic_build, label_import, flatten_props, extraction_run,
    )
}
_DRAW = f"md5('{SEED}|' || doc_id)"
ORACLES = {
    "scan_chunks": "SELECT source, doc_id, length(text) AS chars, n_chars FROM documents",
    "scan_jsonl": "SELECT doc_id, sha256(text) AS text_sha256, lang FROM documents",
    "scan_csv": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer",
    "scan_tsv": "SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier",
    "scan_records": "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark",
    "vtt_parse": r"""SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_index, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms,
        trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""",
    "approved_ids": "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'",
    "metadata_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "semi_anti": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_order FROM customer",
    "set_difference": "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 46)",
    "keep_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1",
    "dedupe_question": r"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '\s+', '', 'g')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "coalesce_fields": "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'fr' THEN '' ELSE lang END, ''), nullif(CASE WHEN n_chars > 1000 THEN source END, ''), 'none') AS value FROM documents",
    "systematic_sample": "WITH n AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r, greatest(1, count(*) OVER () // 50) AS s FROM documents) SELECT doc_id, lang FROM n WHERE (r - 1) % s = 0 AND r <= s * 50",
    "seeded_sample": f"SELECT doc_id, lang FROM documents ORDER BY {_DRAW}, doc_id LIMIT 50",
    "stratified_sample": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_DRAW}, doc_id) AS r FROM documents) ORDER BY r, source LIMIT 90",
    "stratified_two_level": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {_DRAW}, doc_id) AS r2 FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r2, lang) AS r1 FROM a)
        SELECT doc_id, source, lang FROM b ORDER BY r1, source LIMIT 90""",
    "batch_ids": "SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS batch FROM customer",
    "eligible_filter": "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200",
    "split_filter": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')",
    "chunk_header": "SELECT 'page' AS source_kind, page_id AS id, 'page ' || page_id || ' ' || url AS header FROM pages UNION ALL SELECT 'document', doc_id, 'document ' || doc_id || ' (' || lang || ')' FROM documents",
    "corpus_union": "SELECT page_id AS id, url, 'page' AS source_kind, NULL AS lang FROM pages UNION ALL SELECT doc_id, NULL, 'document', lang FROM documents",
    "prefix_resolve": """WITH w AS (SELECT DISTINCT left(sha256(CAST(item_id AS VARCHAR)), 3) AS prefix FROM benchmark), m AS (SELECT prefix, count(doc_id) AS matches FROM w LEFT JOIN documents ON left(sha256(CAST(doc_id AS VARCHAR)), 3) = prefix GROUP BY prefix)
        SELECT prefix, matches, CASE WHEN matches = 1 THEN 'ok' WHEN matches = 0 THEN 'unknown' ELSE 'ambiguous' END AS status FROM m""",
    "validate_rows": """SELECT c_custkey, 'negative balance' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'odd segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')
        UNION ALL SELECT c_custkey, 'empty name' FROM customer WHERE c_name IS NULL OR c_name = '' UNION ALL SELECT c_custkey, 'nation out of range' FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 23""",
    "validate_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "validate_single_config": "SELECT source, count(DISTINCT lang || coalesce(CASE WHEN n_chars > 300 THEN 'v2' END, 'null')) AS variants, count(DISTINCT lang || coalesce(CASE WHEN n_chars > 300 THEN 'v2' END, 'null')) > 1 AS mixed FROM documents GROUP BY source",
    "incremental_plan": """SELECT c_custkey, CASE WHEN n IS NULL THEN 'fetch' WHEN done > 0 THEN 'skip' ELSE 'normalise' END AS action FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "grounding_check": r"""WITH i AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS t FROM benchmark), d AS (SELECT regexp_replace(text, '\s', '', 'g') AS t FROM documents) SELECT item_id, count(d.t) AS documents, count(d.t) > 0 AS grounded FROM i LEFT JOIN d ON contains(d.t, i.t) GROUP BY item_id""",
    "hash_join_lookup": "SELECT p_brand, n_name, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY p_brand, n_name",
    "anchor_join": """SELECT a.doc_id AS anchor_id, a.doc_id + a.doc_id % 2 AS claimed, CASE WHEN length(substr(a.text, 11, 30)) < 20 THEN 'short' WHEN b.text IS NULL THEN 'unknown document' WHEN contains(b.text, substr(a.text, 11, 30)) THEN 'found' ELSE 'missing' END AS status
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + a.doc_id % 2""",
    "ledger_merge": """WITH l AS (SELECT o_custkey AS id, o_orderpriority AS title, o_orderstatus AS review_status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1)
        SELECT coalesce(l.id, c_custkey) AS id, coalesce(c_name, title) AS title, coalesce(c_mktsegment, 'OLD') AS classification, CASE WHEN l.id IS NULL THEN 'PENDING' ELSE review_status END AS review_status, CASE WHEN l.id IS NULL THEN '' ELSE 'seen' END AS review_reason
        FROM l FULL JOIN customer ON c_custkey = l.id WHERE l.id IS NOT NULL OR c_mktsegment = 'BUILDING'""",
    "qa_siblings": """WITH e AS (SELECT conv_id // 10 AS query_id, conv_id * 1000 + turn AS rank, conv_id * 1000 + turn AS chunk_id, conv_id, role FROM conversations WHERE role IN ('user', 'assistant')),
        a AS (SELECT conv_id, conv_id * 1000 + turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'assistant'),
        u AS (SELECT query_id, 0 AS later, rank, 0 AS nth, chunk_id FROM e WHERE role = 'assistant' OR conv_id IN (SELECT conv_id FROM a) UNION ALL SELECT query_id, 1, rank, nth, a.chunk_id FROM e JOIN a USING (conv_id) WHERE role = 'user' AND nth <= 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY later, rank, nth) AS k FROM u)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY later, rank, nth, chunk_id) AS ordinal, chunk_id, later = 1 AS appended FROM o WHERE k = 1""",
    "ordered_distinct": "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY f) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL) GROUP BY o_custkey",
    "corpus_fingerprint": "WITH h AS (SELECT sha256(doc_id || chr(0) || text || chr(0)) AS h FROM documents), g AS (SELECT left(h, 4) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS g FROM h GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(g, '' ORDER BY p)) AS fingerprint FROM g",
    "two_net_pool": f"""{rt._BASE}, {_LEX}, x AS (SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM lx WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = lx.query_id AND r.vec_id = lx.id AND r.rank <= 20))
        SELECT query_id, 'vector' AS net, rank, vec_id AS id FROM r WHERE rank <= 20 UNION ALL SELECT query_id, 'lexical', rank, id FROM x WHERE rank <= 10""",
    "hybrid_merge": f"""{rt._BASE}, {_LEX}, x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM lx), u AS (SELECT query_id, 0 AS l, rank, vec_id AS id FROM r WHERE rank <= 5 UNION ALL SELECT query_id, 1, rank, id FROM x WHERE rank <= 10),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY l, rank) AS k FROM u) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY l, rank, id) AS ordinal, id FROM o WHERE k = 1""",
    "gold_union": f"WITH {rt._Q}, {rt._GOLD}, {_LEX} SELECT query_id, vec_id AS id FROM g WHERE span_id = 0 UNION SELECT query_id, id FROM lx WHERE hits >= 12",
    "prompt_render": f"{_PROMPT} SELECT query_id, prompt FROM p",
    "prompt_citations": f"{_PROMPT} SELECT query_id, n AS number, chunk_id FROM f WHERE citable",
    "answer_pipeline": f"""{_PROMPT}, z AS (SELECT *, CASE WHEN band = 'refuse' THEN 'refused' WHEN blocked THEN 'blocked' ELSE 'prompted' END AS status FROM p)
        SELECT query_id, band, status, CASE WHEN status <> 'prompted' THEN '{lx.REFUSAL}' END AS answer, CASE WHEN status = 'prompted' THEN sha256(prompt) END AS prompt_sha256 FROM z""",
    "backfill_merge": """WITH r AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 10 = 4 THEN 'v1' ELSE 'v2' END AS v, CASE WHEN n_chars < 300 THEN 'refuse' ELSE 'answer' END AS band, CASE WHEN lang = 'de' THEN source END AS answer, doc_id % 4 <> 1 AS generated FROM documents),
        a AS (SELECT doc_id + CASE WHEN doc_id % 100 = 50 THEN 1000000000 ELSE 0 END AS query_id, 'answer ' || doc_id AS text FROM documents WHERE doc_id % 2 = 0),
        s AS (SELECT coalesce(r.query_id, a.query_id) AS query_id, answer, text, CASE WHEN text IS NOT NULL AND r.query_id IS NULL THEN 'unknown' WHEN text IS NOT NULL AND v <> 'v2' THEN 'version mismatch' WHEN text IS NOT NULL AND band = 'refuse' THEN 'refused band'
          WHEN text IS NOT NULL AND coalesce(answer, '') <> '' AND generated THEN 'occupied' WHEN text IS NOT NULL THEN 'filled' WHEN generated AND coalesce(answer, '') = '' THEN 'pending' ELSE 'kept' END AS status FROM r FULL JOIN a ON a.query_id = r.query_id)
        SELECT query_id, status, CASE WHEN status = 'filled' THEN text ELSE answer END AS answer FROM s""",
    "synthetic_build": "WITH " + _SENT + r""", c AS (SELECT doc_id, pos, regexp_replace(sentence, '^(?:[-*•]|\d+[.)])\s+|^["''“]|["''”]$', '', 'g') AS q FROM s),
        f AS (SELECT doc_id, pos, q, row_number() OVER (PARTITION BY lower(regexp_replace(q, '\s', '', 'g')), length(q) >= 40 ORDER BY doc_id, pos) AS r FROM c),
        m AS (SELECT doc_id, pos, CASE WHEN q = '' THEN 'empty' WHEN length(q) < 40 THEN 'short' WHEN r > 1 THEN 'seen before' END AS reason FROM f)
        SELECT doc_id, pos, 's' || lpad(CAST(row_number() OVER (ORDER BY doc_id, pos) AS VARCHAR), 6, '0') AS query_id, 'kept' AS outcome FROM m WHERE reason IS NULL UNION ALL SELECT doc_id, pos, NULL, reason FROM m WHERE reason IS NOT NULL""",
    "label_import": r"""WITH j AS (SELECT doc_id, quality AS label, CAST(n_chars > 1500 AS INT) AS suggestion, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS blocked FROM labels JOIN documents USING (doc_id))
        SELECT doc_id, label, suggestion, label <> suggestion AS differs, blocked, (SELECT count(*) FROM j WHERE blocked) = 0 AS imported FROM j""",
    "flatten_props": """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, '' AS thumbnail, '["' || event_type || '","' || user_id || '"]' AS tags FROM events""",
}
