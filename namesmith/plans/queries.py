"""The library's operators as queries over the test tables, each with the SQL that says the same.

The tables aren't bibliographic, so mentions are derived: a part is a mention
whose first and last name are the two words of its name, whose middle name is
its brand number, whose coauthors are the suppliers of its large orders, and
whose gold entity is its brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import canopies, names, text, vectors
from namesmith.operators import blocking, convert, evaluate, features, hierarchy, near_names, neighbours, pairwise, phrases, profile, report, topics
from namesmith.operators import word_vectors as vectors_of_words
from namesmith.plans.registry import query
from namesmith.schema import MENTION, author, complete
from namesmith.sources import readers, writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    sold = line.where("l_quantity >= 48").groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("s"))
    me = author(word(1), F.array(F.split_part("p_brand", F.lit("#"), F.lit(2))), word(2), None, None, F.array("p_type"))
    others = F.transform(F.coalesce("s", F.array().cast("array<string>")), lambda s: author(None, None, s))
    rows = part.join(sold, part.p_partkey == sold.l_partkey, "left")
    return complete(rows.select(F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("mentionId"), F.col("p_brand").alias("goldEntityId"), me.alias("self"), others.alias("coauthors"), F.col("p_name").alias("title"), F.array("p_type").alias("keywords")))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.assign(mentions(spark, sf_dir), canopies.first_and_last)


#: The mention view in SQL: id, brand, first, last, middle, type, suppliers (list).
M = """WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS sup FROM lineitem WHERE l_quantity >= 48 GROUP BY 1),
m AS (SELECT 'm' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_brand AS brand, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last,
 split_part(p_brand, '#', 2) AS middle, p_type AS kind, coalesce(sup, []) AS sup, p_name AS title FROM part LEFT JOIN s ON p_partkey = l_partkey)"""
BASELINE_SQL = """p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM m x JOIN m y ON x.first = y.first AND x.last = y.last AND x.id < y.id
 WHERE substr(x.middle, 1, 1) = substr(y.middle, 1, 1) AND len(list_intersect(x.sup, y.sup)) >= 1)"""
COMPONENT_SQL = """e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id AS mention_id, coalesce(min(other), id) AS entity_id FROM m LEFT JOIN r ON id = node GROUP BY id)"""


@query("name_normalize", """SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS first, 'b' AS middles, lower(split_part(p_name, ' ', 2)) AS last, 'jr' AS suffixes FROM part""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    raw = author(F.concat(F.lit("\t"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" B  ")), F.array(F.lit("b"), F.split_part("p_name", F.lit(" "), F.lit(2))), F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" , Jr.")))
    done = part.select(F.col("p_partkey").alias("id"), names.case_insensitive_reevaluating(raw).alias("n"))
    return done.select("id", F.col("n.firstName").alias("first"), F.array_join("n.middleNames", ",").alias("middles"), F.col("n.lastName").alias("last"), F.array_join("n.suffixes", ",").alias("suffixes"))


@query("text_functions", r"""SELECT doc_id, md5(regexp_replace(text, '[[:punct:]]', '', 'g')) AS bare, md5(lower(regexp_replace(text, '[[:punct:]]', ' ', 'g'))) AS spaced, md5(translate(text, chr(10) || chr(9), '  ')) AS flat,
 md5(replace(replace(text, chr(10), ''), chr(9), '')) AS joined, nullif(lang, '') AS lang, CAST(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS BIGINT) AS n FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.remove_punctuation(t)).alias("bare"), F.md5(F.lower(text.remove_punctuation(t, " "))).alias("spaced"), F.md5(text.tabs_and_newlines_to_spaces(t)).alias("flat"),
        F.md5(text.remove_newlines_and_tabs(t)).alias("joined"), text.none_if_empty(F.col("lang")).alias("lang"), F.length(text.trim_ends(t)).cast("long").alias("n"),
    )


@query("accents", r"""SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS h, length(text) AS n FROM documents""")
def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("h"), F.length("text").cast("long").alias("n"))


@query("canopies", M + """ SELECT id, 'LAST_' || last || '_FIRST_' || first || '_MIDDLE_' || middle AS full_name, 'LAST_' || last || '_FIRST_' || first AS first_last,
 'LAST_' || last || '_FIRST_' || substr(first, 1, 3) AS first3, 'LAST_' || last || '_FIRST_' || substr(first, 1, 1) AS first1 FROM m""")
def canopy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda n: canopies.from_name(n)(F.col("self"))
    return mentions(spark, sf_dir).select(F.col("mentionId").alias("id"), by("fullName").alias("full_name"), by("firstAndLast").alias("first_last"), by("lastAndFirst3ofFirst").alias("first3"), by("lastAndFirst1ofFirst").alias("first1"))


@query("canopy_tasks", M + """ SELECT 'LAST_' || last || '_FIRST_' || substr(first, 1, 3) AS canopy, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM m GROUP BY 1""")
def canopy_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.tasks(mentions(spark, sf_dir), canopies.last_and_first_n(3)).select("canopy", F.array_join("mention_ids", ",").alias("ids"), "n")


@query("task_lines", M + """ SELECT 'LAST_' || last || '_FIRST_' || first || chr(9) || string_agg(id, ',' ORDER BY id) AS value FROM m GROUP BY last, first""")
def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.task_lines(blocking.tasks(mentions(spark, sf_dir), canopies.first_and_last))


@query("fetch_tasks", M + """ SELECT 'LAST_' || last || '_FIRST_' || first AS canopy, id, title FROM m""")
def fetch_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return blocking.fetch(blocking.tasks(m, canopies.first_and_last), m).select("canopy", F.col("mentionId").alias("id"), "title")


@query("block_sizes", M + """ SELECT 'LAST_' || last || '_FIRST_' || first AS canopy, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM m GROUP BY last, first""")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(mentions(spark, sf_dir), canopies.first_and_last)


@query("restricted_ids", M + """ SELECT id FROM m WHERE id IN (SELECT 'm' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') FROM lineitem WHERE l_quantity >= 48)""")
def restricted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.concat(F.lit("m"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("i"))
    return blocking.restrict(mentions(spark, sf_dir), ids).select(F.col("mentionId").alias("id"))


@query("block_pairs", """SELECT x.lang || x.source AS canopy, x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.lang = y.lang AND x.source = y.source AND x.n_chars = y.n_chars AND x.doc_id < y.doc_id""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", "source", F.lit("/"), F.col("n_chars").cast("string")).alias("canopy"), F.col("doc_id").alias("mentionId"))
    return pairwise.block_pairs(docs).select(F.split_part("canopy", F.lit("/"), F.lit(1)).alias("canopy"), "a", "b")


@query("match_baseline", M + ", " + BASELINE_SQL + " SELECT a, b FROM p")
def match_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.matches(blocked(spark, sf_dir), pairwise.baseline)


@query("match_deterministic", M + """ SELECT DISTINCT x.id AS a, y.id AS b FROM m x JOIN m y ON x.last = y.last AND substr(x.first, 1, 3) = substr(y.first, 1, 3) AND x.id < y.id
 WHERE levenshtein(x.first, y.first) < 8 AND len(list_intersect(x.sup, y.sup)) >= 2""")
def match_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = blocking.assign(mentions(spark, sf_dir), canopies.last_and_first_n(3)).withColumn("self", F.col("self").withField("institutions", F.array().cast("array<string>"))).withColumn("keywords", F.array().cast("array<string>"))
    return pairwise.matches(m, pairwise.deterministic)


@query("match_institutions", """SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey""")
def match_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = blocked(spark, sf_dir).withColumn("coauthors", F.slice("coauthors", F.lit(1), F.lit(0)))
    # Numbers before pairs are made: once for each mention.
    return pairwise.matches(m.withColumn("mentionId", F.substring("mentionId", 2, 9).cast("long")), pairwise.deterministic)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fuller view: parts as mentions with e-mails, institutions, coauthors, topics, keywords, venues and texts from all their lines; every fourth first name is an initial, every ninth absent."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key = lambda head, *c: F.concat(F.lit(head), F.concat_ws("_", *(x.cast("string") for x in c)))
    order, seller = F.col("l_orderkey"), F.col("l_suppkey")
    each = F.struct(
        key("s", seller, order % 7).alias("others"), key("t", order % 97).alias("topics"), F.when(F.expr("l_linenumber = 1 and l_returnflag = 'R'"), key("s", seller, F.lit("@x.org"))).alias("mails"),
        key("v", F.year("l_shipdate"), F.col("l_linestatus")).alias("venues"),
    )
    some = lambda c: F.sort_array(F.array_distinct(c))
    lists = line.groupBy("l_partkey").agg(F.collect_list(each).alias("each"))
    lines = lists.select("l_partkey", *(some(F.col(f"each.{c}")).alias(c) for c in ("others", "topics", "venues")), some(F.array_compact("each.mails")).alias("mails"))
    word, none = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i)), F.array().cast("array<string>")
    first = F.when(F.expr("p_partkey % 9 = 0"), "").when(F.expr("p_partkey % 4 = 0"), F.substring(word(1), 1, 1)).otherwise(word(1))
    me = author(first, F.array(F.split_part("p_brand", F.lit("#"), F.lit(2))), word(2), None, F.coalesce("mails", none), F.array(F.concat("p_brand", "p_type")))
    rows = part.join(lines, part.p_partkey == lines.l_partkey, "left")
    text_of = F.array(word(1), F.lower("p_type"), word(1), key("k", F.col("p_size") % 5))
    return complete(rows.select(
        F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("mentionId"), F.col("p_brand").alias("goldEntityId"), me.alias("self"),
        F.transform(F.coalesce("others", none), lambda s: author(None, None, s)).alias("coauthors"), F.col("p_name").alias("title"), F.array(key("k", F.col("p_size") % 5)).alias("keywords"),
        F.coalesce("topics", none).alias("topics"), F.transform(F.coalesce("venues", none), lambda v: F.struct(v.alias("name"))).alias("venues"), text_of.alias("tokenizedText"),
    ))


#: The fuller view in SQL.
P = """WITH l AS (SELECT l_partkey AS k, list(DISTINCT 's' || l_suppkey || '_' || l_orderkey % 7) AS others, list(DISTINCT 't' || l_orderkey % 97) AS topics,
 list(DISTINCT 's' || l_suppkey || '_@x.org') FILTER (WHERE l_linenumber = 1 AND l_returnflag = 'R') AS mails, list(DISTINCT 'v' || year(l_shipdate) || '_' || l_linestatus) AS venues FROM lineitem GROUP BY 1),
m AS (SELECT 'm' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN p_name[1] ELSE split_part(p_name, ' ', 1) END AS first, split_part(p_name, ' ', 2) AS last, split_part(p_name, ' ', 1) AS head, lower(p_type) AS kind, p_partkey AS k,
 split_part(p_brand, '#', 2) AS middle, p_brand || p_type AS place, 'k' || p_size % 5 AS keyword, coalesce(others, []) AS others, coalesce(topics, []) AS topics, coalesce(mails, []) AS mails, coalesce(venues, []) AS venues, p_name AS title FROM part LEFT JOIN l ON p_partkey = l.k)"""


@query("match_whole_rule", P + """ SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.last = y.last AND substr(x.first, 1, 1) = substr(y.first, 1, 1) AND x.id < y.id
 WHERE levenshtein(x.first, y.first) < 8 AND (len(list_intersect(x.mails, y.mails)) > 0 OR x.place = y.place OR len(list_intersect(x.others, y.others)) >= 2 OR (len(list_intersect(x.topics, y.topics)) >= 8 AND x.keyword = y.keyword))""")
def match_whole_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic rule with all its evidence."""
    return pairwise.matches(blocking.assign(people(spark, sf_dir), canopies.last_and_first_n(1)), pairwise.deterministic)


@query("components", M.replace("WITH", "WITH RECURSIVE", 1) + ", " + BASELINE_SQL + ", " + COMPONENT_SQL + " SELECT mention_id, entity_id FROM c")
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.resolve_pairwise(blocked(spark, sf_dir))


@query("resolve_pairwise", M.replace("WITH", "WITH RECURSIVE", 1) + ", " + BASELINE_SQL + ", " + COMPONENT_SQL + " SELECT mention_id, CAST(dense_rank() OVER (ORDER BY entity_id) - 1 AS VARCHAR) AS entity_id FROM c")
def resolve_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, block, match, connect, renumber."""
    done = mentions(spark, sf_dir).withColumn("self", names.lower_all(F.col("self")))
    return evaluate.renumber(pairwise.resolve_pairwise(blocking.assign(done, canopies.first_and_last)))


@query("renumber", """SELECT mention_id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS VARCHAR) AS entity_id FROM
 (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS mention_id, min(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) OVER (PARTITION BY o_custkey) AS first FROM orders)""")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return evaluate.renumber(orders.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("mention_id"), F.col("o_custkey").cast("string").alias("entity_id")))


def two_clusterings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted: place of the largest component of a vector; gold: its label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("mention_id"), F.array_position("embedding", F.array_max("embedding")).cast("string").alias("p"), F.col("label").cast("string").alias("g"))
    return e.select("mention_id", F.col("p").alias("entity_id")), e.select("mention_id", F.col("g").alias("entity_id"))


CELLS = """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(list_position(embedding, list_max(embedding)) AS VARCHAR) AS p, CAST(label AS VARCHAR) AS g FROM embeddings),
cells AS (SELECT p, g, count(*) AS n FROM e GROUP BY 1, 2), np AS (SELECT p, sum(n) AS np, count(*) AS parts FROM cells GROUP BY 1), ng AS (SELECT g, sum(n) AS ng, count(*) AS parts FROM cells GROUP BY 1),
t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(np * (np - 1) / 2) FROM np) AS pp, (SELECT sum(ng * (ng - 1) / 2) FROM ng) AS gp)"""


@query("pairwise_scores", CELLS + """ SELECT CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(gp - tp AS BIGINT) AS fn, round(tp / pp, 9) AS precision, round(tp / gp, 9) AS recall, round(2 * tp / (pp + gp), 9) AS f1,
 round((gp - tp) / gp, 9) AS splitting, round((pp - tp) / gp, 9) AS lumping, (SELECT count(*) FROM np) AS predicted_entities, (SELECT count(*) FROM ng) AS gold_entities FROM t""")
def pairwise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.pairwise_scores(*two_clusterings(spark, sf_dir))
    return s.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "splitting", "lumping")), "predicted_entities", "gold_entities")


@query("cluster_scores", CELLS + """, b AS (SELECT sum(n * n / np) / sum(n) AS b3_precision, sum(n * n / ng) / sum(n) AS b3_recall FROM cells JOIN np USING (p) JOIN ng USING (g)),
u AS (SELECT (SELECT sum(np - parts) / sum(np - 1) FROM np) AS muc_precision, (SELECT sum(ng - parts) / sum(ng - 1) FROM ng) AS muc_recall)
SELECT round(b3_precision, 9) AS b3_precision, round(b3_recall, 9) AS b3_recall, round(2 * b3_precision * b3_recall / (b3_precision + b3_recall), 9) AS b3_f1,
 round(muc_precision, 9) AS muc_precision, round(muc_recall, 9) AS muc_recall, round(2 * muc_precision * muc_recall / (muc_precision + muc_recall), 9) AS muc_f1 FROM b, u""")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.cluster_scores(*two_clusterings(spark, sf_dir))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns))


@query("pair_outcomes", CELLS + """ SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN x.p = y.p AND x.g = y.g THEN 'tp' WHEN x.p = y.p THEN 'fp' ELSE 'fn' END AS outcome FROM e x JOIN e y ON x.id < y.id AND (x.p = y.p OR x.g = y.g)) GROUP BY 1""")
def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcome_counts(*two_clusterings(spark, sf_dir))


@query("entity_members", CELLS + """ SELECT p AS entity_id, string_agg(id, ',' ORDER BY id) AS members FROM e GROUP BY p""")
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.entity_members(two_clusterings(spark, sf_dir)[0]).select("entity_id", F.array_join("members", ",").alias("members"))


@query("restricted_points", """SELECT CAST(o_orderkey AS VARCHAR) AS mention_id, CAST(o_custkey AS VARCHAR) AS entity_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48)""")
def restricted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("mention_id"), F.col("o_custkey").cast("string").alias("entity_id"))
    return evaluate.restricted(p, table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").cast("string").alias("mention_id")))


@query("error_analysis", M + ", " + BASELINE_SQL + """, o AS (SELECT a, b, CASE WHEN x.brand = y.brand THEN 'tp' ELSE 'fp' END AS outcome FROM p JOIN m x ON a = x.id JOIN m y ON b = y.id)
 SELECT outcome, count(*) AS pairs, count(*) FILTER (WHERE len(list_intersect(x.sup, y.sup)) > 0) AS same_coauthors, 0 AS same_emails, count(*) FILTER (WHERE x.kind = y.kind) AS same_institutions, 0 AS same_venues,
 count(*) FILTER (WHERE x.first = y.first) AS same_first FROM o JOIN m x ON a = x.id JOIN m y ON b = y.id GROUP BY outcome""")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = blocked(spark, sf_dir)
    gold = m.select(F.col("mentionId").alias("id"), "goldEntityId")
    pairs = pairwise.matches(m).join(gold.alias("x"), F.expr("a = x.id")).join(gold.alias("y"), F.expr("b = y.id"))
    return evaluate.error_analysis(pairs.select("a", "b", F.when(F.expr("x.goldEntityId = y.goldEntityId"), "tp").otherwise("fp").alias("outcome")), m)


def keystore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("vec"))


@query("vector_mean", """SELECT l_suppkey AS id, CAST(i AS INT) AS i, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 7) AS x FROM (SELECT l_suppkey, embedding FROM lineitem JOIN embeddings ON l_partkey % 700 = vec_id), range(64) r(i) GROUP BY 1, 2""")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.concat(F.lit("v"), (F.col("l_partkey") % 700).cast("string"))).alias("words"))
    means = features.pooled(line, "l_suppkey", "words", keystore(spark, sf_dir), 64)
    return means.select(F.col("l_suppkey").alias("id"), F.posexplode("vec").alias("i", "x")).select("id", "i", F.round("x", 7).alias("x"))


@query("cosine", """SELECT x.vec_id AS id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS c, round(sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))), 9) AS n FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(y, "vec_id").select(F.col("vec_id").alias("id"), F.round(vectors.cosine(F.col("embedding"), F.col("next")), 9).alias("c"), F.round(vectors.norm(F.col("embedding")), 9).alias("n"))


@query("nearest_words", """SELECT 'v' || y.vec_id AS word, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id = 7 ORDER BY 2 DESC, 1 LIMIT 10""")
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.nearest(keystore(spark, sf_dir), "v7", 10).select("word", F.round("similarity", 9).alias("similarity"))


@query("nearest_many", """SELECT 'v' || q AS query, rank, word, round(similarity, 9) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, word) AS INT) AS rank FROM
 (SELECT x.vec_id AS q, 'v' || y.vec_id AS word, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 12) AS similarity FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0)) WHERE rank <= 10""")
def nearest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: words whose id is divisible by 100, against all."""
    store = keystore(spark, sf_dir)
    asked = store.where(F.substring("word", 2, 20).cast("long") % 100 == 0)
    return neighbours.nearest_exact(asked, store).withColumn("similarity", F.round("similarity", 9))


@query("nearest_index")
def nearest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the index; a test holds its recall against the exact way."""
    store = keystore(spark, sf_dir)
    return neighbours.build(store).search(store.where(F.substring("word", 2, 20).cast("long") % 100 == 0))


TOKENS = "list_filter(string_split(lower(text), ' '), lambda x: x <> '')"


@query("token_counts", f"SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_counts(table(spark, sf_dir, "benchmark"), "item_id", F.split(F.lower("text"), " "))


@query("bag_scores", f"""WITH t AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2), s AS (SELECT item_id, sum(n) AS total, count(*) AS kinds FROM t GROUP BY 1),
 h AS (SELECT item_id, -sum(n / total * ln(n / total)) / ln(max(kinds)) AS entropy, max(kinds) / max(total) AS prior FROM t JOIN s USING (item_id) GROUP BY 1),
 d AS (SELECT x.item_id, sum(x.n * y.n) AS dot FROM t x JOIN t y ON y.item_id = x.item_id + 1 AND y.token = x.token GROUP BY 1), q AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY 1)
 SELECT h.item_id, round(entropy, 9) AS entropy, round(prior, 9) AS prior, round(coalesce(dot, 0) / (x.norm * y.norm), 9) AS cosine FROM h JOIN q x ON x.item_id = h.item_id JOIN q y ON y.item_id = h.item_id + 1 LEFT JOIN d ON d.item_id = h.item_id""")
def bag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", vectors.bag(text.non_empty(F.split(F.lower("text"), " "))).alias("bag"))
    y = b.select((F.col("item_id") - 1).alias("item_id"), F.col("bag").alias("next"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return b.join(y, "item_id").select("item_id", r(vectors.bag_entropy(F.col("bag")), "entropy"), r(vectors.size_prior(F.col("bag")), "prior"), r(vectors.bag_cosine(F.col("bag"), F.col("next")), "cosine"))


@query("bag_algebra", f"""WITH t AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2)
 SELECT coalesce(x.item_id, y.item_id - 1) AS item_id, coalesce(x.token, y.token) AS token, CAST(coalesce(x.n, 0) + coalesce(y.n, 0) AS DOUBLE) AS both, CAST(coalesce(x.n, 0) - coalesce(y.n, 0) AS DOUBLE) AS less
 FROM (SELECT * FROM t WHERE item_id < (SELECT max(item_id) FROM t)) x FULL JOIN (SELECT * FROM t WHERE item_id > (SELECT min(item_id) FROM t)) y ON y.item_id = x.item_id + 1 AND y.token = x.token""")
def bag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", vectors.bag(text.non_empty(F.split(F.lower("text"), " "))).alias("bag"))
    y = b.select((F.col("item_id") - 1).alias("item_id"), F.col("bag").alias("next"))
    both = b.join(y, "item_id").select("item_id", vectors.bag_minus(F.col("bag"), F.col("next")).alias("less"), F.explode(vectors.bag_sum(F.col("bag"), F.col("next"))).alias("token", "both"))
    return both.select("item_id", "token", "both", vectors.bag_value(F.col("less"), F.col("token")).alias("less"))


@query("merged_bags", """SELECT conv_id, token, CAST(count(*) AS DOUBLE) AS n FROM (SELECT conv_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token FROM conversations) GROUP BY 1, 2""")
def merged_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", vectors.bag(text.non_empty(F.split("text", " "))).alias("bag"))
    return features.merged_bags(turns, "conv_id", "bag").select("conv_id", F.explode("bag").alias("token", "n"))


WORDS = r"string_split_regex(regexp_replace(lower(regexp_replace({}, '[[:punct:]]', ' ', 'g')), '^\s+|\s+$', '', 'g'), '\s+')"


def phrase_sql(end: str) -> str:
    return f"""WITH b AS (SELECT {WORDS.format("text")} AS w FROM benchmark), v AS (SELECT DISTINCT w[i] || '_' || w[i + 1] AS phrase FROM b, range(1, 200) r(i) WHERE i + 1 <= len(w)),
 d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), c AS (SELECT doc_id, i, w[i] || '_' || w[i + 1] AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w){end})) AS i FROM d))
 SELECT d.doc_id AS id, coalesce(p, '') AS phrases FROM d LEFT JOIN (SELECT doc_id, string_agg(phrase, ' ' ORDER BY i) AS p FROM c JOIN v USING (phrase) GROUP BY 1) USING (doc_id)"""


def phrase_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = text.split_trimmed(phrases.phrase_text(F.col("text")), r"\s+")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), "_"))
    vocabulary = table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("phrase")).distinct()
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), phrases.phrase_text(F.col("text")).alias("text")), vocabulary


@query("phrase_tags", phrase_sql(""))
def phrase_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.tag_phrases(*phrase_inputs(spark, sf_dir), longest=2).select("id", F.array_join("phrases", " ").alias("phrases"))


@query("phrase_tags_exclusive", phrase_sql(" - 1"))
def phrase_tags_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that end at the last word are out of bounds, and with a longest length of three those of three."""
    return phrases.tag_phrases(*phrase_inputs(spark, sf_dir), longest=3, inclusive=False).select("id", F.array_join("phrases", " ").alias("phrases"))


@query("training_text", r"""SELECT md5(lower(regexp_replace(t, '[[:punct:]]', '', 'g'))) AS h FROM (SELECT regexp_replace(role || ' ' || text, '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE t <> ''""")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.training_text(table(spark, sf_dir, "conversations").select(F.col("role").alias("title"), "text")).select(F.md5("text").alias("h"))


@query("record_text", r"""SELECT conv_id, turn, md5(lower(regexp_replace(role || ' ' || text, '[[:punct:]]', ' ', 'g'))) AS h FROM conversations""")
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(convert.record_text(F.col("role"), F.col("text"))).alias("h"))


@query("json_fields", """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("tag_values", r"""SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g') AS title, len(regexp_extract_all(html, '<b>')) AS bold FROM pages""")
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(text.first_tag_value(h, "title"), F.lit("")).alias("title"), F.regexp_count(h, F.lit("<b>")).cast("long").alias("bold"))


@query("field_profile", """SELECT event_type AS field, count(*) AS occurrences, (SELECT count(*) FROM (SELECT user_id FROM events y WHERE y.event_type = x.event_type GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM events x GROUP BY 1""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_profile(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("shared_values", """SELECT 'supplier' AS attribute, count(*) AS values, count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2)
 UNION ALL SELECT 'flag', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT l_returnflag, l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2)""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return profile.shared_values(line, {"supplier": F.array(F.col("l_suppkey").cast("string")), "flag": F.array("l_returnflag")}, "l_partkey", "l_orderkey")


@query("edit_distance", """SELECT p_partkey AS id, levenshtein(p_name, p_type) AS distance, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) < 5 AS near FROM part""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.edit_distance(F.col("p_name"), F.col("p_type")).cast("long").alias("distance"), (F.levenshtein(word(1), word(2), 4) >= 0).alias("near"))


@query("near_names", """WITH n AS (SELECT DISTINCT p_brand AS block, p_name || ' ' || p_size AS name FROM part)
 SELECT x.block, x.name AS a, y.name AS b, levenshtein(x.name, y.name) AS distance FROM n x JOIN n y ON x.block = y.block AND x.name < y.name WHERE levenshtein(x.name, y.name) <= 3""")
def close_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand within three edits, by segments."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    return near_names.near_names(rows, "p_brand", "name", 3).withColumn("distance", F.col("distance").cast("long"))


@query("years", """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') AS year FROM orders""")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.year_of(F.col("o_orderdate").cast("string")).alias("year"))


@query("clean_fields", """SELECT s_suppkey AS id, replace(lower(s_name), '#', '') || '|' || 'grp' AS offices, lower(regexp_replace(s_name, '[^A-Za-z.@]', '', 'g')) || '@a.b' AS mail, replace(lower(regexp_replace(s_name, '[0-9]', '', 'g')), '#', '') AS journal FROM supplier""")
def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    offices = text.clean_institutions(F.array(F.concat(name, F.lit(",Univ.,g\trp,The"))))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array_join(offices, "|").alias("offices"), F.array_join(text.clean_emails(F.array(F.concat(name, F.lit("@a.b")))), "|").alias("mail"), F.array_join(text.clean_journals(F.array(F.concat(name, F.lit("year: 1999,Proc.,x")))), "|").alias("journal")
    )


@query("stable_distinct", """SELECT conv_id, turn, CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT) AS kinds, string_split(text, ' ')[1] AS head FROM conversations""")
def stable_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.first_of_each(F.split("text", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(kept).cast("long").alias("kinds"), F.get(kept, F.lit(0)).alias("head"))


@query("looked_up", """SELECT p_partkey AS id, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON p_partkey = l_partkey""")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("v"))
    return convert.looked_up(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), side, "id", "v").select("id", F.size("v").cast("long").alias("n"))


@query("same_names", """SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey""")
def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).select(F.substring("mentionId", 2, 9).cast("long").alias("id"), names.name_key(F.col("self")).alias("name"), "title")
    return pairwise.equal_pairs(m.where("title is not null"), "id", ["title", "name"])


@query("formatted_names", M + " SELECT id, last || ', ' || first || ' ' || middle AS name, substr(middle, 1, 1) AS initials FROM m")
def formatted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select(F.col("mentionId").alias("id"), names.formatted(F.col("self")).alias("name"), F.array_join(names.middle_initials(F.col("self")), "").alias("initials"))


@query("saturation", "SELECT l_orderkey AS id, l_linenumber AS line, least(16.0, l_quantity * 0.5) AS penalty FROM lineitem")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), vectors.saturating(F.col("l_quantity"), 0.5, 16.0).alias("penalty"))


@query("record_html", "SELECT n_nationkey AS id, '<ul><li><b>n_nationkey</b>: ' || n_nationkey || '</li><li><b>n_name</b>: ' || n_name || '</li><li><b>n_regionkey</b>: ' || n_regionkey || '</li></ul>' AS html FROM nation")
def record_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.record_html(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).select(F.col("n_nationkey").alias("id"), "html")


@query("json_view", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def json_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_view(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("keyword_lines", "SELECT p_partkey || chr(9) || split_part(p_name, ' ', 1) || chr(9) || split_part(p_name, ' ', 2) AS value FROM part")
def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.keyword_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.split("p_name", " ").alias("v")), "k", "v")


@query("debug_columns", M + " SELECT id AS \"mentionId\", first, middle AS middles, last, array_to_string(sup, ',') AS coauthors, kind AS institutions, title, kind AS keywords FROM m")
def debug_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.debug_columns(mentions(spark, sf_dir))


@query("feature_bags", M + " SELECT id, 1 AS firsts, 1 AS middles, len(sup) AS coauthors, 1 AS institutions, 1 AS keywords FROM m")
def feature_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long").alias({"firstNames": "firsts", "middleNames": "middles"}.get(c, c))
    return features.mention_bags(mentions(spark, sf_dir)).select(F.col("mentionId").alias("id"), *(n(c) for c in ("firstNames", "middleNames", "coauthors", "institutions", "keywords")))


@query("json_round_trip", M + """ SELECT id, last, array_to_string(sup, ',') AS coauthors, 'UNK_SOURCE' AS source FROM m""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as JSON text and back; keys that are left out become absent values."""
    text_of = mentions(spark, sf_dir).drop("source", "canopy")
    back = complete(report.json_view(text_of).select(F.from_json("value", MENTION).alias("m")).select("m.*"))
    return back.select(F.col("mentionId").alias("id"), F.col("self.lastName").alias("last"), F.array_join(F.transform("coauthors", lambda a: a["lastName"]), ",").alias("coauthors"), "source")


@query("paper_mentions", """WITH p AS (SELECT l_orderkey, 's' || l_suppkey AS last, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, last ORDER BY place) AS nth FROM p)
 SELECT l_orderkey || '_LN_' || last || '_FN_ab' || CASE WHEN nth > 1 THEN '_' || place ELSE '' END AS id, last, n - 1 AS others FROM q""")
def paper_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a paper, its lines as authors; ids keep letters, digits, - and _ only."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("lines"))
    authors = F.transform("lines", lambda x: author(F.lit("a.b "), None, F.concat(F.lit("s"), x["l_suppkey"].cast("string"))))
    nobody = F.array(author(F.lit("x")))
    papers = line.select(F.col("l_orderkey").cast("string").alias("paperId"), F.concat(authors, nobody).alias("authors"), F.lit("t").alias("title"), F.lit("").alias("year"), F.array(F.lit("v")).alias("venues"), F.lit("").alias("abstractText"))
    return readers.paper_mentions(papers).select(F.col("mentionId").alias("id"), F.col("self.lastName").alias("last"), F.size("coauthors").cast("long").alias("others"))


@query("tagged_authors", """SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS first, p_type AS middles, split_part(p_name, ' ', 2) AS last FROM part""")
def tagged_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    tags = F.concat(F.lit("<n><f> "), word(1), F.lit("</f><f>"), F.col("p_type"), F.lit("</f><m>gone</m><l>"), word(2), F.lit(" </l><l>no</l></n>"))
    a = readers.tagged_author(tags)
    return part.select(F.col("p_partkey").alias("id"), a["firstName"].alias("first"), F.array_join(a["middleNames"], ",").alias("middles"), a["lastName"].alias("last"))


@query("paper_tokens", """SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) || '||' || lower(replace(p_brand, '#', '')) AS title, lower(replace(p_brand, '#', ' ')) AS text FROM part""")
def paper_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title tokens keep what was all punctuation as ""; text tokens don't."""
    part = table(spark, sf_dir, "part")
    title = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" -- "), F.col("p_brand"))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(convert.title_tokens(title), "|").alias("title"), F.array_join(convert.text_tokens(F.col("p_brand")), " ").alias("text"))


@query("result_folders", """SELECT DISTINCT CASE WHEN p_name LIKE 's%' THEN 'misc' ELSE substr(p_brand, 1, 5) || '-' || substr(split_part(p_brand, '#', 2), 1, 1) END AS folder FROM part""")
def result_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.startswith(F.col("p_name"), F.lit("s")), F.col("p_name")).otherwise(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))
    return table(spark, sf_dir, "part").select(writers.prefix(name).alias("folder")).distinct()


@query("hierarchical")
def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled clustering: repeatable, but not SQL."""
    return hierarchy.resolve(mentions(spark, sf_dir), [canopies.from_name(c) for c in canopies.DEFAULT])


@query("topics")
def topic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", convert.text_tokens(F.col("text")).alias("tokens"))
    return topics.topics(docs, "doc_id", "tokens").select("doc_id", F.array_join("topics", ",").alias("topics"))


@query("word_vectors")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(convert.text_tokens(F.col("text")).alias("tokens"))
    return vectors_of_words.word_vectors(lines, "tokens")
