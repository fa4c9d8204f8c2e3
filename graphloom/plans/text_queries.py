"""Queries of the sampling, abstraction, verbalisation, answer and scoring families, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import answers, models, sampling, verbal
from ..sources import files, star
from ..streaming import answer_rounds
from . import materialise
from .star_queries import FACTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- sampling -------------------------------------------------------------------------------------------------------
_EDGES = """e AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x),
 w AS (SELECT lo, hi, CAST(greatest(1, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * (q3 - q1) / pow(n, 1.0 / 3)))) AS BIGINT) AS bins FROM e)"""


@query("m_bins", f"WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders), {_EDGES}, b AS (SELECT greatest(0, CAST(ceil((v - lo) / ((hi - lo) / bins)) AS BIGINT) - 1) AS bin FROM x CROSS JOIN w) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def m_bins(spark, d):
    o = _t(spark, d, "orders").select("o_totalprice")
    edges = sampling.histogram_edges(o, "o_totalprice")
    return o.select(sampling.bucket(F.col("o_totalprice"), edges).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("m_distinct_filter", "SELECT DISTINCT o_orderstatus AS status, regexp_replace(o_orderpriority || '-BIN', '-(BIN|MC)$', '') AS priority FROM orders WHERE o_orderstatus IN ('F', 'O')")
def m_distinct_filter(spark, d):
    o = _t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select(F.col("o_orderstatus").alias("status"), F.regexp_replace(F.concat("o_orderpriority", F.lit("-BIN")), "-(BIN|MC)$", "").alias("priority")).dropDuplicates()


@query("m_strata", "SELECT stratum, n FROM (SELECT o_orderstatus || '_' || o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 2")
def m_strata(spark, d):
    o = _t(spark, d, "orders").select(F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("stratum"))
    return o.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("m_first_per_group", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def m_first_per_group(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("m_split", "WITH r AS (SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders) SELECT o_orderkey, stratum FROM r WHERE k <= greatest(1, round(n * 0.05))")
def m_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("stratum"))
    return sampling.split(o, "stratum", "o_orderkey").where("chosen").select("o_orderkey", "stratum")


@query("m_split_total", "WITH o AS (SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority AS stratum FROM orders), g AS (SELECT stratum, count(*) AS n FROM o GROUP BY 1), t AS (SELECT sum(n) AS n_all, count(*) AS m, least(greatest(200, count(*)), sum(n)) AS want FROM g), s AS (SELECT stratum, n, want - m AS more, greatest(0, round((n - 1) * (want - m)::DOUBLE / (n_all - m), 9)) AS x FROM g, t), q AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS k, more - sum(floor(x)) OVER () AS rest FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM o) SELECT o_orderkey, stratum FROM r JOIN q USING (stratum) WHERE place <= 1 + floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END")
def m_split_total(spark, d):
    """A sample of 200 rows in all, dealt to strata by largest remainders."""
    o = _t(spark, d, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("stratum"))
    return sampling.split(o, "stratum", "o_orderkey", total=200).where("chosen").select("o_orderkey", "stratum")


# ---- abstraction ----------------------------------------------------------------------------------------------------
_TERMS = "terms AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term, 'class' AS category FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2], 'object property' FROM part WHERE contains(p_name, ' ') UNION SELECT DISTINCT p_brand, 'individual' FROM part)"


def _terms(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    words = F.split("p_name", " ")
    a = p.select(words.getItem(0).alias("term"), F.lit("class").alias("category"))
    b = p.where(F.col("p_name").contains(" ")).select(words.getItem(1).alias("term"), F.lit("object property").alias("category"))
    return a.unionByName(b).unionByName(p.select(F.col("p_brand").alias("term"), F.lit("individual").alias("category"))).distinct()


@query("a_terms", f"WITH {_TERMS} SELECT category, count(*) AS n FROM terms GROUP BY category")
def a_terms(spark, d):
    return _terms(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_SOLVED = f"{_TERMS}, solved AS (SELECT term, arg_min(category, CASE category WHEN 'class' THEN 1 WHEN 'object property' THEN 2 WHEN 'data property' THEN 3 ELSE 4 END) AS category FROM terms GROUP BY term)"
_NUMBERED = f"{_SOLVED}, numbered AS (SELECT category, term, CASE category WHEN 'class' THEN 'Class' WHEN 'object property' THEN 'Property' ELSE 'Individual' END || row_number() OVER (PARTITION BY category ORDER BY term) AS abstract FROM solved)"


@query("a_overlap", f"WITH {_SOLVED} SELECT term, category FROM solved")
def a_overlap(spark, d):
    return verbal.resolve_overlap(_terms(spark, d)).select("term", "category")


@query("a_numbering", f"WITH {_NUMBERED} SELECT category, term, abstract FROM numbered")
def a_numbering(spark, d):
    return verbal.numbered(verbal.resolve_overlap(_terms(spark, d))).select("category", "term", "abstract")


@query("a_rewrite", f"WITH {_NUMBERED}, w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) SELECT p_partkey, string_agg(coalesce(abstract, w), ' ' ORDER BY k) AS p_name FROM w LEFT JOIN numbered ON w = term GROUP BY p_partkey")
def a_rewrite(spark, d):
    mapping = verbal.numbered(verbal.resolve_overlap(_terms(spark, d)))
    return verbal.rewrite(_t(spark, d, "part").select("p_partkey", "p_name"), mapping, "p_partkey", "p_name")


@query("a_mode", "SELECT regexp_extract(url, '^(https?://[^/]+/)', 1) AS namespace, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 5")
def a_mode(spark, d):
    return _t(spark, d, "pages").groupBy(F.regexp_extract("url", "^(https?://[^/]+/)", 1).alias("namespace")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


# ---- verbalisation --------------------------------------------------------------------------------------------------
@query("v_clean_name", "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace('part_' || p_name || '_1885', '_\\d{4}$', ''), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS name FROM part")
def v_clean_name(spark, d):
    return _t(spark, d, "part").select("p_partkey", verbal.clean_name(F.concat(F.lit("part_"), "p_name", F.lit("_1885"))).alias("name"))


@query("v_property_name", f"WITH {FACTS} SELECT p, lower(regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS name, count(*) AS n FROM facts GROUP BY p")
def v_property_name(spark, d):
    return star.facts(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", verbal.property_name(F.col("p")).alias("name"), "n")


_LISTED = "CASE WHEN len(os) = 1 THEN os[1] WHEN len(os) = 2 THEN os[1] || ' and ' || os[2] ELSE array_to_string(os[:-2], ', ') || ', and ' || os[-1] END"


@query("v_sentence", f"WITH {FACTS}, g AS (SELECT s, list_sort(list(o)) AS os FROM facts WHERE p = 'hasPart' GROUP BY s) SELECT s, s || ' has part ' || {_LISTED} || '.' AS text FROM g")
def v_sentence(spark, d):
    g = star.facts(spark, d, ("hasPart",)).groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
    return g.select("s", verbal.sentence(F.col("s"), F.col("p"), F.col("os")).alias("text"))


@query("v_individual_text", f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE p IN ('inNation', 'inRegion')), ou AS (SELECT s AS i, p, s || CASE p WHEN 'inNation' THEN ' in nation ' ELSE ' in region ' END || o || '.' AS t, 0 AS k FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY o, p ORDER BY s) AS n FROM f), inn AS (SELECT o AS i, p, list_sort(list(s)) AS os FROM r WHERE n <= 5 GROUP BY o, p), allt AS (SELECT i, p, t, k FROM ou UNION ALL SELECT i, p, i || ' is reached by ' || CASE p WHEN 'inNation' THEN 'in nation' ELSE 'in region' END || ' from ' || {_LISTED} || '.', 1 FROM inn) SELECT i, string_agg(t, ' ' ORDER BY k, p) AS text FROM allt GROUP BY i")
def v_individual_text(spark, d):
    return verbal.individual_text(star.facts(spark, d, ("inNation", "inRegion")))


@query("v_structural_type", f"WITH {FACTS}, c AS (SELECT p, count(DISTINCT s) AS n FROM facts GROUP BY p) SELECT p, CASE WHEN n % 13 > 10 THEN 'hierarchical' WHEN n % 30 > 20 THEN 'relational' WHEN n > 50 THEN 'instance_heavy' ELSE 'general' END AS kind FROM c")
def v_structural_type(spark, d):
    c = star.facts(spark, d).groupBy("p").agg(F.count_distinct("s").alias("n"))
    return c.select("p", verbal.structural_type(F.lit(0), F.col("n") % 30, F.col("n"), F.col("n") % 13).alias("kind"))


# ---- answers --------------------------------------------------------------------------------------------------------
# Synthetic replies over orders, in integer arithmetic, so that both engines build the same texts.
_REPLY = "reply AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'BIN' ELSE 'MC' END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN '[ERROR] timeout' WHEN o_orderkey % 2 = 0 THEN 'ANSWER: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'False' END || chr(10) || 'CONFIDENCE: 0.' || (o_orderkey % 10) || chr(10) || 'STEPS: ' || (o_orderkey % 14) ELSE 'ANSWER: Customer ' || o_custkey || '; <http://x.org/a#Part_' || (o_orderkey % 7) || '>' || CASE WHEN o_orderkey % 5 = 0 THEN '; ghost' ELSE '' END || chr(10) || 'CONFIDENCE: ' || (o_orderkey % 3) END AS text, 'm' || (o_orderkey % 3) AS model, o_custkey, o_orderkey % 7 AS secs FROM orders)"


def replies(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    binary = F.concat(F.lit("ANSWER: "), F.when(k % 3 == 0, "yes").otherwise("False"), F.lit("\nCONFIDENCE: 0."), s(k % 10), F.lit("\nSTEPS: "), s(k % 14))
    open_ = F.concat(F.lit("ANSWER: Customer "), s(F.col("o_custkey")), F.lit("; <http://x.org/a#Part_"), s(k % 7), F.lit(">"), F.when(k % 5 == 0, "; ghost").otherwise(""), F.lit("\nCONFIDENCE: "), s(k % 3))
    text = F.when(k % 13 == 0, "[ERROR] timeout").when(k % 2 == 0, binary).otherwise(open_)
    return _t(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, "BIN").otherwise("MC").alias("kind"), text.alias("text"), F.concat(F.lit("m"), s(k % 3)).alias("model"), "o_custkey", (k % 7).alias("secs"))


@query("l_extract_answer", f"WITH {_REPLY} SELECT id, CASE WHEN id % 13 = 0 THEN 'ERROR' WHEN kind = 'BIN' THEN CASE WHEN id % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END ELSE 'Customer ' || o_custkey || '; Part_' || (id % 7) || CASE WHEN id % 5 = 0 THEN '; ghost' ELSE '' END END AS answer FROM reply")
def l_extract_answer(spark, d):
    return replies(spark, d).select("id", answers.final_answer(F.col("text"), F.col("kind")).alias("answer"))


@query("l_confidence", f"WITH {_REPLY} SELECT id, CASE WHEN id % 13 = 0 THEN 0.5::DOUBLE WHEN kind = 'BIN' THEN CAST('0.' || (id % 10) AS DOUBLE) ELSE least(1, id % 3)::DOUBLE END AS confidence FROM reply")
def l_confidence(spark, d):
    return replies(spark, d).select("id", answers.confidence(F.col("text")).alias("confidence"))


@query("l_steps", f"WITH {_REPLY} SELECT id, CASE WHEN id % 13 = 0 OR kind = 'MC' THEN 1::DOUBLE ELSE least(10, greatest(1, id % 14))::DOUBLE END AS steps FROM reply")
def l_steps(spark, d):
    return replies(spark, d).select("id", answers.reasoning_steps(F.col("text")).alias("steps"))


@query("l_answer_type", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MC' WHEN 2 THEN 'MC' ELSE 'BIN' END AS kind FROM orders")
def l_answer_type(spark, d):
    spelled = F.element_at(F.array(*map(F.lit, ["Multi Choice", "Binary", " mc ", "other"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", answers.answer_type(spelled).alias("kind"))


@query("l_context_join", "SELECT o_orderkey, CASE WHEN text IS NULL THEN '[ERROR: no context]' WHEN length(text) > 15000 THEN left(text, 15000) || ' [truncated]' ELSE text END AS context FROM orders LEFT JOIN documents ON o_orderkey = doc_id")
def l_context_join(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.length("text") > 15_000, F.concat(F.substring("text", 1, 15_000), F.lit(" [truncated]"))).otherwise(F.col("text")).alias("context"))
    o = _t(spark, d, "orders").select("o_orderkey")
    return o.join(docs, o.o_orderkey == docs.doc_id, "left").select("o_orderkey", F.coalesce("context", F.lit("[ERROR: no context]")).alias("context"))


@query("l_patterns", "SELECT role, count(*) AS n, count(*) FILTER (len(string_split_regex(trim(text), '\\s+')) <= 5) AS short, count(*) FILTER (len(string_split_regex(trim(text), '\\s+')) BETWEEN 6 AND 10) AS medium, count(*) FILTER (contains(text, '?')) AS asks FROM conversations GROUP BY role")
def l_patterns(spark, d):
    c = _t(spark, d, "conversations").withColumn("w", F.size(F.split(F.trim("text"), r"\s+")))
    n = lambda x: F.count(F.when(x, 1))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), n(F.col("w") <= 5).alias("short"), n(F.col("w").between(6, 10)).alias("medium"), n(F.col("text").contains("?")).alias("asks"))


@query("l_perf_summary", f"WITH {_REPLY} SELECT model, count(*) AS n, CAST(sum(CASE WHEN text LIKE '[ERROR]%' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(secs) FILTER (secs > 0), 6) AS mean, round(stddev_samp(secs) FILTER (secs > 0), 6) AS std, min(secs) FILTER (secs > 0) AS least, max(secs) AS most, median(secs) FILTER (secs > 0) AS mid FROM reply GROUP BY model")
def l_perf_summary(spark, d):
    pos = F.when(F.col("secs") > 0, F.col("secs"))
    return replies(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("text").startswith("[ERROR]"), 1)).alias("errors"), F.round(F.avg(pos), 6).alias("mean"), F.round(F.stddev_samp(pos), 6).alias("std"), F.min(pos).alias("least"), F.max("secs").alias("most"), F.median(pos).alias("mid"))


@query("l_pivot", f"WITH {_REPLY} SELECT o_custkey, max(text) FILTER (model = 'm0') AS m0_response, max(text) FILTER (model = 'm1') AS m1_response, max(text) FILTER (model = 'm2') AS m2_response FROM reply GROUP BY o_custkey")
def l_pivot(spark, d):
    wide = replies(spark, d).groupBy("o_custkey").pivot("model", ["m0", "m1", "m2"]).agg(F.max("text"))
    return wide.select("o_custkey", *(F.col(m).alias(f"{m}_response") for m in ("m0", "m1", "m2")))


@query("l_prompt", "SELECT conv_id, turn, 'Answer from the context alone. ' || CASE WHEN turn % 2 = 0 THEN 'List every answer, separated by ''; ''.' ELSE 'Answer TRUE or FALSE.' END || chr(10) || 'Question: ' || role || chr(10) || 'Context: ' || left(text, 10000) || chr(10) || 'ANSWER:' AS prompt, md5(text)[1:8] AS hash FROM conversations")
def l_prompt(spark, d):
    c = _t(spark, d, "conversations")
    text = models.prompt(F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, "MC").otherwise("BIN"))
    return c.select("conv_id", "turn", text.alias("prompt"), F.substring(F.md5("text"), 1, 8).alias("hash"))


@query("l_estimate", f"WITH {_REPLY} SELECT kind, count(*) * 3 * 3.0::DOUBLE / 8 AS seconds FROM reply GROUP BY kind")
def l_estimate(spark, d):
    return replies(spark, d).groupBy("kind").agg((F.count(F.lit(1)) * 3 * F.lit(3.0) / 8).alias("seconds"))


_ROUND_MS = 400 * 86_400_000 + 43_200_000


@query(
    "l_answer_rounds",
    f"""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS task_id, 'm' || (o_orderkey % 3) AS model, 'r' || o_orderkey AS response, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms FROM orders),
 best AS (SELECT task_id, model, ms, response FROM r QUALIFY row_number() OVER (PARTITION BY task_id, model ORDER BY ms, response) = 1),
 kept AS (SELECT *, min(ms) OVER (PARTITION BY task_id) AS opened FROM best QUALIFY ms <= opened + {_ROUND_MS})
 SELECT task_id, CASE WHEN count(*) = 3 THEN 'complete' ELSE 'timeout' END AS closed_by, CAST(count(*) AS INTEGER) AS answered, string_agg(model || ':' || response || '@' || (ms - opened), ',' ORDER BY model) AS answers
 FROM kept GROUP BY task_id, opened HAVING count(*) = 3 OR opened + {_ROUND_MS} <= (SELECT max(ms) FROM r)""",
)
def l_answer_rounds(spark, d):
    """Orders as a stream of answers: a customer's question closes when three models answered or 400 days and a half are over."""
    # a pattern, as the stream's source takes a folder or a pattern and a table may be one file
    orders = spark.readStream.schema(_t(spark, d, "orders").schema).parquet(f"{d}/orders.parque[t]")
    text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    stream = orders.select(F.col("o_custkey").cast("string").alias("task_id"), text("m", F.col("o_orderkey") % 3).alias("model"), text("r", F.col("o_orderkey")).alias("response"), F.lit(1.0).alias("seconds"), F.col("o_orderdate").cast("timestamp").alias("at"))
    out = materialise.new_dir(spark, "rounds")
    answer_rounds.write_rounds(stream, ["m0", "m1", "m2"], out, materialise.new_dir(spark, "rounds-state"), available_now=True, wait_ms=_ROUND_MS, delay="0 seconds").awaitTermination()
    answers_text = F.array_join(F.transform("answers", lambda a: F.concat(a["model"], F.lit(":"), a["response"], F.lit("@"), a["after_ms"].cast("string"))), ",")
    return answer_rounds.read_rounds(spark, out).select("task_id", "closed_by", "answered", answers_text.alias("answers"))


# ---- scoring --------------------------------------------------------------------------------------------------------
_CASES = """cases AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'BIN' ELSE 'MC' END AS kind, 'm' || (c_custkey % 3) AS model, c_custkey % 5 AS k, CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE (c_custkey % 11) / 10.0::DOUBLE END AS conf FROM customer),
 scored AS (SELECT *, CASE WHEN kind = 'BIN' THEN CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0 END WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 2 / 3.0::DOUBLE WHEN k = 2 THEN 0.75 WHEN k = 3 THEN 0.0 ELSE 1.0 END AS score FROM cases)"""
_REAL = "CASE WHEN kind = 'BIN' THEN CASE WHEN k = 0 THEN 'TRUE' ELSE 'FALSE' END ELSE '' END"


def cases(spark, d) -> DataFrame:
    """Expected and given answers: open ones name three nodes; some drop one, add one, name others or reorder."""
    i = F.col("c_custkey")
    s, k = i.cast("string"), i % 5
    trio = F.concat(F.lit("node a"), s, F.lit("; node b"), s, F.lit("; node c"), s)
    given = F.when(k == 0, trio).when(k == 1, F.concat(F.lit("node a"), s, F.lit("; node b"), s)).when(k == 2, F.concat(trio, F.lit("; zzz"))).when(k == 3, "qqq, rrr").otherwise(F.concat(F.lit(" Node B"), s, F.lit(";NODE C"), s, F.lit("; node_a"), s, F.lit(";node A"), s))
    kind = F.when(i % 4 == 0, "BIN").otherwise("MC")
    c = _t(spark, d, "customer")
    return c.select(
        i.alias("id"), kind.alias("kind"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.when(i % 4 == 0, "TRUE").otherwise(trio).alias("expected"),
        F.when(i % 4 == 0, F.when(k == 0, "true").otherwise("false")).otherwise(F.regexp_replace(given, "node_a", "node a")).alias("actual"),
        F.when(i % 11 != 10, (i % 11) / F.lit(10.0)).alias("conf"),
    )


def scored(spark, d) -> DataFrame:
    return cases(spark, d).withColumn("score", answers.accuracy(F.col("expected"), F.col("actual"), F.col("kind")))


@query("x_jaccard", f"WITH {_CASES} SELECT id, round(score, 9) AS score FROM scored")
def x_jaccard(spark, d):
    return scored(spark, d).select("id", F.round("score", 9).alias("score"))


@query("x_calibration", f"WITH {_CASES} SELECT id, round(1 - abs(coalesce(conf, 1.0) - CASE WHEN score >= 1 THEN 1 ELSE 0 END), 9) AS calibration FROM scored")
def x_calibration(spark, d):
    return scored(spark, d).select("id", F.round(answers.calibration(F.col("conf"), F.col("score")), 9).alias("calibration"))


@query("x_hallucination", f"WITH {_CASES} SELECT id, CASE WHEN kind = 'BIN' THEN NULL WHEN k = 2 THEN 0.25 WHEN k = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS rate FROM scored")
def x_hallucination(spark, d):
    return cases(spark, d).select("id", answers.hallucination(F.col("expected"), F.col("actual"), F.col("kind")).alias("rate"))


@query("x_summary", f"WITH {_CASES} SELECT model, coalesce(kind, 'ALL') AS answer_type, count(*) AS n, count(*) FILTER (score >= 1) AS perfect, count(*) FILTER (score > 0 AND score < 1) AS partial, count(*) FILTER (score <= 0) AS wrong, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM scored GROUP BY GROUPING SETS ((model), (model, kind))")
def x_summary(spark, d):
    return answers.summary(scored(spark, d).select("model", F.col("kind").alias("answer_type"), "score"))


@query("x_rank_u", f"WITH {_CASES} SELECT a.model AS a, b.model AS b, CAST(count(DISTINCT a.id) AS BIGINT) AS n_a, CAST(count(DISTINCT b.id) AS BIGINT) AS n_b, sum(CASE WHEN round(a.score, 9) > round(b.score, 9) THEN 1.0::DOUBLE WHEN round(a.score, 9) = round(b.score, 9) THEN 0.5 ELSE 0 END) AS u FROM scored a JOIN scored b ON a.model < b.model GROUP BY 1, 2")
def x_rank_u(spark, d):
    return answers.rank_sum(scored(spark, d).select("model", F.round("score", 9).alias("score")))


_DRAWS = f"""{_CASES}, counts AS (SELECT model, score, count(*) AS n FROM scored GROUP BY model, score),
 named AS (SELECT *, md5('42|' || model || '|' || CAST(round(score * 1e9) AS BIGINT) || '|' || k) AS h FROM counts, (SELECT unnest(range(1, 1001)) AS k)),
 drawn AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u, (('0x' || substr(h, 9, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS v FROM named),
 poisson(n0, upto) AS (VALUES {', '.join(f'({n}, {answers.poisson_table(n)})' for n in range(1, answers.TABLED + 1))}),
 weighed AS (SELECT *, CASE WHEN upto IS NULL THEN greatest(0, round(n + sqrt(n) * sqrt(-2 * ln(u)) * cos(2 * 3.141592653589793::DOUBLE * v))) ELSE len(list_filter(upto, lambda c: c < u))::DOUBLE END AS w FROM drawn LEFT JOIN poisson ON n = n0),
 means AS (SELECT model, k, sum(n) AS n, sum(score * w) / nullif(sum(w), 0) AS m FROM weighed GROUP BY model, k),
 intervals AS (SELECT model, CASE WHEN max(n) > 30 THEN avg(m) END AS mean, CASE WHEN max(n) > 30 THEN quantile_cont(m, 0.025) END AS low, CASE WHEN max(n) > 30 THEN quantile_cont(m, 0.975) END AS high FROM means GROUP BY model)"""


@query("x_bootstrap", f"WITH {_DRAWS} SELECT model, round(mean, 7) AS mean, round(low, 7) AS low, round(high, 7) AS high FROM intervals")
def x_bootstrap(spark, d):
    found = answers.bootstrap(scored(spark, d).select("model", "score"))
    return found.select("model", *(F.round(c, 7).alias(c) for c in ("mean", "low", "high")))


@query("x_interval_texts", f"WITH {_DRAWS} SELECT model, printf('%.1f%%', 100 * mean) AS mean_accuracy, printf('%.1f%%', 100 * low) AS confidence_interval_lower, printf('%.1f%%', 100 * high) AS confidence_interval_upper, printf('%.1f%%', 50 * (high - low)) AS margin_of_error FROM intervals")
def x_interval_texts(spark, d):
    return answers.interval_texts(answers.bootstrap(scored(spark, d).select("model", "score")))


_GROUPS = ["D", "H", "T", "S", "I", "R", "N", "M"]


@query("x_tag_groups", f"WITH {_CASES}, t AS (SELECT id, score, ['DHH', 'DIIRM', 'DDTT', 'DSS', 'DR', 'DDNN'][id % 6 + 1] AS tag FROM scored), g AS (SELECT *, unnest(['D', 'H', 'T', 'S', 'I', 'R', 'N', 'M']) AS grp FROM t) SELECT grp, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM t), 6) AS share FROM g WHERE contains(tag, grp) GROUP BY grp HAVING count(*) >= 3")
def x_tag_groups(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ["DHH", "DIIRM", "DDTT", "DSS", "DR", "DDNN"])), (F.col("id") % 6 + 1).cast("int"))
    t = scored(spark, d).withColumn("tag", tag)
    total = t.count()
    g = t.withColumn("grp", F.explode(F.array(*map(F.lit, _GROUPS)))).where(F.col("tag").contains(F.col("grp")))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.round(100.0 * F.count(F.lit(1)) / F.lit(total), 6).alias("share")).where("n >= 3")


@query("x_usable", f"WITH {_REPLY} SELECT model, count(*) FILTER (id % 13 <> 0) AS usable FROM reply GROUP BY model")
def x_usable(spark, d):
    return replies(spark, d).groupBy("model").agg(F.count(F.when(answers.usable(F.col("text")), 1)).alias("usable"))


@query("x_query_index", f"WITH {FACTS} SELECT 'SELECT ?x WHERE {{ <{names.FAMILY}' || s || '> <{names.FAMILY}hasPart> ?x }}' AS query, string_agg(s || '|hasPart|' || o, ',' ORDER BY s || '|hasPart|' || o) AS keys FROM facts WHERE p = 'hasPart' GROUP BY s")
def x_query_index(spark, d):
    f = star.facts(spark, d, ("hasPart",))
    normal = F.regexp_replace(F.regexp_replace(names.select(F.col("s"), F.col("p")), r"\s+", " "), r"[. ]+$", "")
    return f.select(normal.alias("query"), names.triple_key(F.col("s"), F.col("p"), F.col("o")).alias("key")).groupBy("query").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


@query("x_final_grouping", "WITH q AS (SELECT 'Membership' AS task, CASE WHEN conv_id % 2 = 0 THEN 'BIN' ELSE 'MC' END AS kind, 'root_' || conv_id AS root, text AS context, role, turn FROM conversations WHERE text IS NOT NULL) SELECT task, kind, root, context, count(*) AS n, string_agg(role || turn, ',' ORDER BY role || turn) AS qas FROM q GROUP BY task, kind, root, context")
def x_final_grouping(spark, d):
    c = _t(spark, d, "conversations")
    q = c.select(F.lit("Membership").alias("Task Type"), F.when(F.col("conv_id") % 2 == 0, "BIN").otherwise("MC").alias("Answer Type"), F.concat(F.lit("root_"), "conv_id").alias("Root Entity"), F.col("text").alias("NL Context"), F.concat("role", F.col("turn").cast("string")).alias("SPARQL Query"), F.col("text").alias("NL Question"), F.lit("TRUE").alias("Answer"))
    entries = files.benchmark_entries(q)
    return entries.select(F.col("Task Type").alias("task"), F.col("Answer Type").alias("kind"), F.col("Root Entity").alias("root"), F.col("NL Context").alias("context"), F.size("QAs").cast("long").alias("n"), F.array_join(F.transform("QAs", lambda x: x["SPARQL Query"]), ",").alias("qas"))


@query("x_events_json", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def x_events_json(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
