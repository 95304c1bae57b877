"""Queries of merge, comparison, exclusion and assignment operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import audit as A
from epochal.operators import corpus as C
from epochal.sources.views import table


def strict_merge(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    a = l.where("doc_id % 3 <> 0").select("doc_id", F.create_map(F.lit("q"), F.col("quality").cast("double")).alias("m"))
    b = l.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("q"), F.col("toxic").cast("double"), F.lit("t"), F.lit(1.0)).alias("m"))
    m = A.strict_merge(a, b, "doc_id", "m")
    return m.select("doc_id", F.try_element_at("merged", F.lit("q")).alias("q"), F.try_element_at("merged", F.lit("t")).alias("t"), "side")


def matrix_gaps(spark, sf_dir):
    """Order lines by statuses: which (line, status) cells of an order are absent."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus").distinct()
    r, c = l.select("l_orderkey", "l_linenumber").distinct(), l.select("l_orderkey", "l_linestatus").distinct()
    return A.matrix_gaps(r, c, l, "l_orderkey", "l_linenumber", "l_linestatus")


def exclude_known(spark, sf_dir):
    """Customers of nation 0 are released; others of the same segment and balance sign go, by steps."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.array("c_mktsegment", F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string"))).alias("tags"))
    c = c.withColumn("tags", F.slice("tags", 2, 1))
    return A.exclude_known(c, c.where("c_nationkey = 0"), ["c_custkey", "c_nationkey"], ["tags"])[1]


def version_delta(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("gold"))
    old = l.where("doc_id % 5 <> 0").select("doc_id", ((F.col("doc_id") * 7) % 11 / 10.0).alias("score"))
    new = l.where("doc_id % 7 <> 0").select("doc_id", ((F.col("doc_id") * 3) % 11 / 10.0).alias("score"))
    return A.version_delta(old, new, l, "doc_id").groupBy("outcome").agg(F.count("*").alias("n"))


def field_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    q = p.withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_size"))).withColumn("p_brand", F.lower("p_brand"))
    return A.field_changes(p, q, "p_partkey")


def fingerprints(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(A.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("card")).agg(F.count("*").alias("n"))


def longest_and_hashed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return A.longest_and_hashed(d, "doc_id", F.col("n_chars"), C.stable_order("cal", F.col("doc_id")), 20, 30)


def answered_by_all(spark, sf_dir):
    """Return flags as systems, the largest part as the answer: orders with all three flags and a part each."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_partkey").alias("l_partkey"))
    return A.answered_by_all(l, "l_orderkey", "l_returnflag", "l_partkey", 3)


def chunked_lines(spark, sf_dir):
    """Order lines packed in order into chunks of 60 items."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("n"))
    return l.select("l_orderkey", (F.element_at(A.greedy_chunks(F.col("n"), 60), -1) + 1).alias("chunks"))


def relation_vectors(spark, sf_dir):
    """Each order's first two lines as events: shipped on a day, lasting their quantity."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2)").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))).alias("s"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    a, b = l.where("l_linenumber = 1"), l.where("l_linenumber = 2").select("l_orderkey", F.col("s").alias("s2"), F.col("q").alias("q2"))
    j = a.join(b, "l_orderkey")
    v = A.relation_vector(F.col("s"), F.col("s") + F.col("q"), F.col("s2"), F.col("s2") + F.col("q2"))
    return j.select("l_orderkey", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("relation"))


def verify_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: x * 1).alias("ids"), F.when(F.col("vec_id") % 9 == 0, F.array(*(F.lit(float(x)) for x in range(10)))).otherwise(F.array(*(F.lit(float(-x)) for x in range(10)))).alias("s"))
    return A.verify_predictions(p, "i", "ids", "s", 600, 10)


def power_floor(spark, sf_dir):
    return A.power_floor(table(spark, sf_dir, "documents"), "lang", "source", 50, 10)


def question_uniqueness(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return A.same_text_different_answer(p, F.lower(F.col("p_type")), "p_brand")


def cross_partition(spark, sf_dir):
    """Exact copies whose documents are in different splits."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("a"))
    pairs = d.join(first, "h").where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    return A.cross_partition(pairs, C.stable_splits(d, "doc_id"), "doc_id", "split")


def cross_partition_near(spark, sf_dir):
    """Every document with its smallest near duplicate (similarity 0.9, copies included) in each other split. Tested against brute force."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.cross_partition_near(C.near_duplicates(d), C.near_duplicate_members(d), C.stable_splits(d, "doc_id"), "doc_id", "split")


def balanced_assignment(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return A.balanced_assignment(d, "doc_id", "n_chars", 7).groupBy("rater").agg(F.count("*").alias("units"), F.sum("n_chars").alias("cost"))


def temperature(spark, sf_dir):
    """A fitted number: rows only."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return A.temperature(d.withColumn("z", (F.col("doc_id") % 7) - 3.0 + 2 * F.col("quality")), ["lang"], "z", "quality")


_NAMES = """strict_merge matrix_gaps exclude_known version_delta field_changes fingerprints longest_and_hashed answered_by_all chunked_lines relation_vectors
verify_predictions power_floor question_uniqueness cross_partition cross_partition_near balanced_assignment temperature""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_SPLIT = "CASE WHEN b < 600 THEN 'train' WHEN b < 750 THEN 'dev' WHEN b < 950 THEN 'test_auto' ELSE 'reserve' END"
SQL = {
    "strict_merge": """WITH a AS (SELECT doc_id, quality::DOUBLE AS q FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic::DOUBLE AS q, 1.0::DOUBLE AS t FROM labels WHERE doc_id % 2 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.q, a.q) AS q, b.t AS t, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "matrix_gaps": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus FROM lineitem), w AS (SELECT DISTINCT a.l_orderkey, a.l_linenumber, b.l_linestatus FROM l a JOIN l b USING (l_orderkey))
SELECT *, 'missing' AS fault FROM (SELECT * FROM w EXCEPT SELECT * FROM l)""",
    "exclude_known": """WITH c AS (SELECT *, c_mktsegment || CAST(c_custkey % 50 AS VARCHAR) AS tag FROM customer), r AS (SELECT * FROM c WHERE c_nationkey = 0), x AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM r)),
y AS (SELECT * FROM x WHERE c_nationkey NOT IN (SELECT c_nationkey FROM r)), z AS (SELECT * FROM y WHERE tag NOT IN (SELECT tag FROM r))
SELECT 'population' AS step, count(*) AS "left" FROM c UNION ALL SELECT 'c_custkey', count(*) FROM x UNION ALL SELECT 'c_nationkey', count(*) FROM y UNION ALL SELECT 'tags', count(*) FROM z""",
    "version_delta": """WITH d AS (SELECT quality::DOUBLE AS g, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 7) % 11 / 10.0::DOUBLE END AS o, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 3) % 11 / 10.0::DOUBLE END AS n FROM labels)
SELECT CASE WHEN o IS NULL AND n IS NULL THEN 'missing' WHEN o IS NULL THEN 'coverage_added' WHEN n IS NULL THEN 'coverage_removed' WHEN abs(n - g) < abs(o - g) THEN 'closer' WHEN abs(n - g) > abs(o - g) THEN 'farther' ELSE 'same' END AS outcome, count(*) AS n FROM d GROUP BY 1""",
    "field_changes": """SELECT 'p_brand' AS field, count(*) FILTER (WHERE lower(p_brand) <> p_brand) AS changed FROM part UNION ALL SELECT 'p_size', count(*) FILTER (WHERE p_partkey % 4 = 0 AND p_size IS NOT NULL) FROM part UNION ALL SELECT 'p_type', 0 FROM part GROUP BY 1""",
    "fingerprints": "SELECT sha256(lower(p_brand) || chr(31) || lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) || chr(31) || CAST(p_size AS VARCHAR)) AS card, count(*) AS n FROM part GROUP BY 1",
    "longest_and_hashed": """WITH t AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20), h AS (SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t) ORDER BY sha256('cal:' || CAST(doc_id AS VARCHAR)) LIMIT 30)
SELECT *, 'long' AS why FROM t UNION ALL SELECT *, 'hash' FROM h""",
    "answered_by_all": "SELECT l_orderkey FROM (SELECT l_orderkey, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey HAVING count(*) = 3 AND count(DISTINCT p) = 3",
    "chunked_lines": """WITH RECURSIVE n AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INT)) AS i FROM lineitem),
r AS (SELECT l_orderkey, i, q AS used, 1 AS chunk FROM n WHERE i = 1 UNION ALL SELECT n.l_orderkey, n.i, CASE WHEN r.used > 0 AND r.used + n.q > 60 THEN n.q ELSE r.used + n.q END, r.chunk + (r.used > 0 AND r.used + n.q > 60)::INT FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1)
SELECT l_orderkey, max(chunk) AS chunks FROM r GROUP BY l_orderkey""",
    "relation_vectors": """WITH l AS (SELECT l_orderkey, l_linenumber, min(CAST(l_shipdate AS DATE) - DATE '1990-01-01') AS s, max(CAST(l_quantity AS INT)) AS q FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL),
j AS (SELECT a.l_orderkey, a.s AS s1, a.s + a.q AS e1, b.s AS s2, b.s + b.q AS e2 FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
k AS (SELECT l_orderkey, least(s1, s2) AS lo, nullif(greatest(e1, e2) - least(s1, s2), 0)::DOUBLE AS w, s1, e1, s2, e2 FROM j),
v AS (SELECT l_orderkey, round((s1 - lo) / w, 4) AS a, round((e1 - lo) / w, 4) AS b, round((s2 - lo) / w, 4) AS c, round((e2 - lo) / w, 4) AS d FROM k)
SELECT l_orderkey, concat_ws(',', a < c, a > c, a < d, a > d, b < c, b > c, b < d, b > d) AS relation FROM v""",
    "verify_predictions": """SELECT 'depth' AS fault, 0::BIGINT AS n UNION ALL SELECT 'repeated_id', 0 UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'unsorted', count(*) FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT 'out_of_range', count(*) FROM embeddings WHERE vec_id >= 600
UNION ALL SELECT 'repeated_index', 0 UNION ALL SELECT 'missing_index', 600 - count(DISTINCT vec_id) FROM embeddings""",
    "power_floor": "SELECT lang, count(*) AS pairs, count(DISTINCT source) AS clusters, count(*) >= 50 AND count(DISTINCT source) >= 10 AS enough FROM documents GROUP BY lang",
    "question_uniqueness": "SELECT lower(p_type) AS text, min(p_brand) AS low, max(p_brand) AS high, count(*) AS n FROM part GROUP BY 1 HAVING min(p_brand) <> max(p_brand)",
    "cross_partition": f"""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, ('0x' || sha256('split:' || CAST(doc_id AS VARCHAR))[1:16])::UBIGINT % 1000 AS b FROM documents), s AS (SELECT doc_id, h, {_SPLIT} AS p FROM d)
SELECT x.doc_id AS a, y.doc_id AS b, x.p AS pa, y.p AS pb FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id AND x.p <> y.p WHERE x.doc_id = (SELECT min(doc_id) FROM s z WHERE z.h = x.h)""",
    "balanced_assignment": """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM labels JOIN documents USING (doc_id))
SELECT CAST(CASE WHEN (r // 7) % 2 = 0 THEN r % 7 ELSE 6 - r % 7 END AS INT) AS rater, count(*) AS units, CAST(sum(n_chars) AS BIGINT) AS cost FROM r GROUP BY 1""",
}
