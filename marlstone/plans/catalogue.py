"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import WORD, top
from marlstone.functions.lineage import kept, scratch
from marlstone.operators import align, dense, expand, extract, fusion, graph, inverted, learner, linking, metrics, search, sparse, vectorindex
from marlstone.operators import text as T
from marlstone.plans import domain as D
from marlstone.plans.domain import NOW, sql
from marlstone.sources import keyed, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "search_end_to_end"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


LATIN = T.KEEP_LATIN.replace("\\s", "\\s").replace("'", "''")
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CLEAN = lambda x: f"trim(regexp_replace(regexp_replace({x}, '{SPACES}', ' ', 'g'), '{LATIN}', '', 'g'))"


# ---- text


@query(sql("corpus") + f", c AS (SELECT doc_id, lang, {CLEAN('title')} AS title, {CLEAN('content')} AS content FROM corpus) SELECT doc_id, lang, md5(title) AS title_md5, md5(content) AS content_md5, length(content)::INT AS n FROM c WHERE length(content) BETWEEN 50 AND 10000")
def clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    out = T.clean_corpus(D.corpus(spark, d))
    return out.select("doc_id", "lang", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), F.length("content").alias("n"))


TOKENS = f"""tokens AS (SELECT doc_id, field, unnest(regexp_extract_all(lower(value), '{WORD}')) AS term FROM (SELECT doc_id, 'title' AS field, title AS value FROM corpus UNION ALL SELECT doc_id, 'content', content FROM corpus))"""


@query(sql("corpus") + f", {TOKENS} SELECT field, term, sum(tf)::BIGINT AS cf, count(*) AS df, max(tf) AS max_tf FROM (SELECT field, term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL) GROUP BY ALL")
def tokenize_postings(spark: SparkSession, d: str) -> DataFrame:
    return T.postings(D.corpus(spark, d)).groupBy("field", "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


BM25 = f"""{TOKENS},
terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '{WORD}')) AS term FROM questions),
lens AS (SELECT c.doc_id, f.field, coalesce(n, 0) AS len FROM corpus c CROSS JOIN (VALUES ('title'), ('content')) f(field) LEFT JOIN (SELECT doc_id, field, count(*) AS n FROM tokens GROUP BY ALL) t ON t.doc_id = c.doc_id AND t.field = f.field),
sizes AS (SELECT field, avg(len) AS avg_len, count(*) AS n FROM lens GROUP BY field),
tf AS (SELECT field, term, doc_id, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
idf AS (SELECT field, term, ln(n / (df + 1)::DOUBLE) + 1 AS idf, avg_len FROM (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL) JOIN sizes USING (field)),
bm AS (SELECT qid, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 9) AS score FROM tf JOIN idf USING (field, term) JOIN lens USING (field, doc_id) JOIN terms USING (term) GROUP BY ALL),
sparse_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM bm) WHERE rank <= 50)"""


@query(sql("corpus", "questions") + f", {BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM sparse_run WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.bm25(D.corpus(spark, d), D.questions(spark, d)).select("qid", "doc_id", "rank", *r6("score"))


def stored_index(spark: SparkSession, d: str, path: str) -> inverted.Index:
    """The corpus in two segments: half of it is there, the other half is appended."""
    index, docs = inverted.Index(spark, path), D.corpus(spark, d)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index.append(docs.where(half == 0))
    index.append(docs.where(half == 1))
    return index


@query(sql("corpus", "questions") + f", {BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM sparse_run WHERE rank <= 10")
def stored_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as path:
        return scratch.held(stored_index(spark, d, path).search(D.questions(spark, d)).select("qid", "doc_id", "rank", *r6("score")))


@query(sql("corpus", "questions").replace("FROM documents)", "FROM documents WHERE lang = 'en')") + f", {BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM sparse_run WHERE rank <= 10")
def stored_bm25_merged(spark: SparkSession, d: str) -> DataFrame:
    """Documents in English, from segments that were merged."""
    with scratch(spark) as path:
        index = stored_index(spark, d, path)
        index.merge()
        index.sweep()
        return scratch.held(index.search(D.questions(spark, d), lang="en").select("qid", "doc_id", "rank", *r6("score")))


@query(sql("corpus") + ", ids AS (SELECT DISTINCT item_id AS doc_id FROM benchmark) SELECT doc_id, lang, md5(content) AS content_md5, concept AS concepts FROM corpus SEMI JOIN ids USING (doc_id)")
def doc_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = sparse.lookup(D.corpus(spark, d), D.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")))
    return found.select("doc_id", "lang", F.md5("content").alias("content_md5"), F.array_join("concepts", ",").alias("concepts"))


# ---- dense retrieval and evaluation

DENSE = """scored AS (SELECT qid, doc_id, round(list_dot_product(q.vector, v.vector), 9) AS score FROM vector_queries q JOIN vectors v ON qid <> doc_id),
dense_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= 50)"""
DENSE_SQL = sql("vectors") + f", {DENSE}"


def dense_run(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return dense.exact(D.vectors(spark, d), D.vector_queries(spark, d), k, itself=False)


@query(DENSE_SQL + " SELECT qid, doc_id, rank, round(score, 6) AS score FROM dense_run WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense_run(spark, d, 10).select("qid", "doc_id", "rank", *r6("score"))


def hash_vectors(cte: str, source: str, key: str, column: str) -> str:
    return f"""{cte}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({column}), '{WORD}')) AS w FROM {source}),
{cte}_n AS (SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 768) AS b, count(*)::DOUBLE AS c FROM {cte}_w WHERE length(w) > 1 GROUP BY ALL),
{cte} AS (SELECT {key}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {cte}_n)"""


HASHED = f"""{hash_vectors("hd", "corpus", "doc_id", "content")}, {hash_vectors("hq", "questions", "qid", "query")},
hashed AS (SELECT qid, doc_id, round(coalesce(score, 0), 9) AS score FROM (SELECT qid, doc_id FROM questions, corpus) LEFT JOIN (SELECT qid, doc_id, sum(hd.x * hq.x) AS score FROM hd JOIN hq USING (b) GROUP BY ALL) USING (qid, doc_id)),
hash_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM hashed) WHERE rank <= 50)"""


def hash_run(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    docs = dense.hashed(D.corpus(spark, d), "doc_id", "content")
    return dense.exact(docs, dense.hashed(D.questions(spark, d), "qid", "query"), k)


@query(sql("corpus", "questions") + f", {HASHED} SELECT qid, doc_id, rank, round(score, 6) AS score FROM hash_run WHERE rank <= 10")
def hashing_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return hash_run(spark, d, 10).select("qid", "doc_id", "rank", *r6("score"))


#: Cells of ivf_topk, and how many of them a query searches: enough for a recall of 0.9 without the query's own row.
CELLS, PROBED = 32, 24


@query()
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    cells, centres = dense.build_cells(D.vectors(spark, d), nlist=CELLS)
    return dense.probe(cells, centres, D.vector_queries(spark, d), 10, PROBED)


EVAL = f"""{DENSE},
hits AS (SELECT qid, doc_id, rank, coalesce(rel, 0) AS rel FROM dense_run LEFT JOIN qrels USING (qid, doc_id)),
ideal AS (SELECT qid, sum(CASE WHEN i <= 10 THEN (2.0::DOUBLE ** rel - 1) / log2(i + 1.0::DOUBLE) ELSE 0 END) AS idcg, count(*) FILTER (rel > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS i FROM qrels) GROUP BY qid),
sums AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN (2.0::DOUBLE ** rel - 1) / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, max(CASE WHEN rel > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr,
  count(*) FILTER (rel > 0 AND rank <= 50) AS r, count(*) FILTER (rel > 0 AND rank <= 10) AS p, sum(CASE WHEN rel > 0 THEN s / rank::DOUBLE ELSE 0 END) AS ps
  FROM (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) AS s FROM hits) GROUP BY qid),
evaluated AS (SELECT qid, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, mrr, CASE WHEN relevant > 0 THEN r / relevant::DOUBLE ELSE 0 END AS recall, p / 10.0::DOUBLE AS precision, CASE WHEN relevant > 0 THEN ps / relevant ELSE 0 END AS ap FROM sums JOIN ideal USING (qid)),
summary AS (SELECT unnest([{{'metric': 'ndcg@10', 'value': avg(ndcg)}}, {{'metric': 'mrr', 'value': avg(mrr)}}, {{'metric': 'recall@50', 'value': avg(recall)}}, {{'metric': 'precision@10', 'value': avg(precision)}}, {{'metric': 'map', 'value': avg(ap)}}], recursive := true) FROM evaluated)"""
EVAL_SQL = sql("vectors", "qrels") + f", {EVAL}"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    run = kept(dense_run(spark, d))  # read twice, and small
    return metrics.per_query(run, D.vector_judged(spark, d, run), grades=D.vector_grades(spark, d))


def _metric(column: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return evaluated(spark, d).select("qid", *r6(column))

    run.__name__ = f"eval_{'map' if column == 'ap' else column}"
    query(EVAL_SQL + f" SELECT qid, round({column}, 6) AS {column} FROM evaluated")(run)


for _column in ("ndcg", "mrr", "recall", "precision", "ap"):
    _metric(_column)


@query(EVAL_SQL + " SELECT metric, round(value, 6) AS value FROM summary")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(evaluated(spark, d)).select("metric", *r6("value"))


def _compare_sql() -> str:
    short = EVAL.replace("dense_run LEFT JOIN", "(SELECT * FROM dense_run WHERE rank <= 5) LEFT JOIN")
    one = lambda body, name: f"SELECT '{name}' AS run, * FROM (WITH {body} SELECT round(avg(ap), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS \"ndcg@10\", round(avg(precision), 6) AS \"precision@10\", round(avg(recall), 6) AS \"recall@50\" FROM evaluated)"
    return sql("vectors", "qrels") + f" {one(EVAL, 'full')} UNION ALL {one(short, 'short')}"


@query(_compare_sql())
def eval_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    run = kept(dense_run(spark, d))
    out = metrics.compare({"full": run, "short": run.where("rank <= 5")}, D.vector_judged(spark, d, run), D.vector_grades(spark, d))
    return out.select("run", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ("map", "mrr", "ndcg@10", "precision@10", "recall@50")])


# ---- graph


@query(sql("graph") + ", m AS (SELECT n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'fr' ELSE 'en' END AS lang, CASE WHEN n_regionkey < 2 THEN 'LOCATION' ELSE 'CONCEPT' END AS type, n_nationkey AS seq FROM nation UNION ALL SELECT upper(p_name), 'en', 'CONCEPT', 1000 + p_partkey FROM part UNION ALL SELECT p_name, 'en', 'CONCEPT', 10000000 + p_partkey FROM part), f AS (SELECT arg_min(name, seq) AS name, arg_min(lang, seq) AS lang, arg_min(type, seq) AS type, min(seq) AS seq FROM m GROUP BY lower(name || '_' || lang)) SELECT lang || '_' || type || '_' || lpad((row_number() OVER (PARTITION BY type ORDER BY seq) - 1)::VARCHAR, 6, '0') AS id, name, lang, type FROM f")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(mentions(spark, d)).select("id", "name", "lang", "type")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    n = D.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") % 2 == 0, "fr").otherwise("en").alias("lang"), F.when(F.col("n_regionkey") < 2, "LOCATION").otherwise("CONCEPT").alias("type"), F.col("n_nationkey").cast("long").alias("seq"))
    p = D.table(spark, d, "part")
    one = p.select(F.upper("p_name").alias("name"), F.lit("en").alias("lang"), F.lit("CONCEPT").alias("type"), (1000 + F.col("p_partkey")).alias("seq"))
    two = p.select(F.col("p_name").alias("name"), F.lit("en").alias("lang"), F.lit("CONCEPT").alias("type"), (10000000 + F.col("p_partkey")).alias("seq"))
    return n.unionByName(one).unionByName(two).withColumn("source_doc", F.lit(None).cast("string"))


@query(sql("graph") + ", ids AS (SELECT lower(name) AS name, arg_min(id, seq) AS id FROM nodes GROUP BY 1), r AS (SELECT source || ' ' || lang AS head, 'SRC0 ' || upper(lang) AS tail FROM (SELECT DISTINCT source, lang FROM documents)) SELECT a.id AS source, b.id AS target, 'RELATED_TO' AS type FROM r JOIN ids a ON lower(head) = a.name JOIN ids b ON lower(tail) = b.name")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "documents").select("source", "lang").distinct().select(F.concat_ws(" ", "source", "lang").alias("head"), F.concat(F.lit("SRC0 "), F.upper("lang")).alias("tail"), F.lit(None).cast("string").alias("type"))
    return graph.edges(rows, D.concept_nodes(spark, d))


@query(sql("graph") + ", ids AS (SELECT lower(name) AS name, arg_min(id, seq) AS id FROM nodes GROUP BY 1), r AS (SELECT DISTINCT source || ' en' AS a, source || ' fr' AS b FROM documents) SELECT x.id AS source, y.id AS target, 'ALIGNED_WITH' AS type, TRUE AS bidirectional FROM r JOIN ids x ON a = x.name JOIN ids y ON b = y.name")
def alignment_edges(spark: SparkSession, d: str) -> DataFrame:
    pairs = D.table(spark, d, "documents").select("source").distinct().select(F.concat(F.col("source"), F.lit(" en")).alias("entity1"), F.concat(F.col("source"), F.lit(" fr")).alias("entity2"))
    return graph.alignment_edges(pairs, D.concept_nodes(spark, d))


@query(sql("graph") + " SELECT 'nodes' AS kind, 'all' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'node_lang', lang, count(*) FROM nodes GROUP BY lang UNION ALL SELECT 'node_type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type")
def graph_basic_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.basic_stats(D.concept_nodes(spark, d), D.concept_edges(spark, d))


DEGREES = "deg AS (SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) GROUP BY id)"


@query(sql("graph") + f", {DEGREES} SELECT round(avg(n_in) FILTER (n_in > 0), 6) AS avg_in, max(n_in) AS max_in, round(avg(n_out) FILTER (n_out > 0), 6) AS avg_out, max(n_out) AS max_out, (SELECT count(*) FROM nodes ANTI JOIN deg USING (id)) AS isolated FROM deg")
def graph_degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_stats(D.concept_nodes(spark, d), D.concept_edges(spark, d))


@query(sql("graph") + f", {DEGREES} SELECT id, n_in, n_out, degree, name, lang, type FROM (SELECT *, n_in + n_out AS degree FROM deg ORDER BY degree DESC, id LIMIT 10) JOIN nodes USING (id)")
def graph_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_nodes(D.concept_nodes(spark, d), D.concept_edges(spark, d))


REACH = ", walk AS (SELECT id AS a, id AS b FROM nodes UNION SELECT walk.a, l.b FROM walk JOIN links l ON walk.b = l.a), labels AS (SELECT b AS id, min(n.seq) AS label FROM walk JOIN nodes n ON n.id = walk.a GROUP BY 1) SELECT label, count(*) AS size FROM labels GROUP BY label"


@query(sql("graph") + ", links AS (SELECT DISTINCT source AS a, target AS b FROM edges)" + REACH)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(D.concept_nodes(spark, d), D.concept_edges(spark, d))


@query(sql("graph") + ", links AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges WHERE type <> 'ALIGNED_WITH' UNION ALL SELECT target, source FROM edges WHERE type <> 'ALIGNED_WITH'))" + REACH)
def graph_wcc(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(D.concept_nodes(spark, d), D.concept_edges(spark, d).where("type <> 'ALIGNED_WITH'"))


@query(sql("graph") + """, al AS (SELECT source, target FROM edges WHERE type = 'ALIGNED_WITH'), ends AS (SELECT source AS id FROM al UNION SELECT target FROM al)
SELECT 'edges' AS kind, 'all' AS name, count(*)::DOUBLE AS value FROM al UNION ALL SELECT 'aligned_nodes', 'all', count(*)::DOUBLE FROM ends
UNION ALL SELECT 'pair', least(a.lang, b.lang) || '-' || greatest(a.lang, b.lang), count(*)::DOUBLE FROM al JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target GROUP BY 2
UNION ALL SELECT 'coverage', lang, round(avg((e.id IS NOT NULL)::INT), 6) FROM nodes n LEFT JOIN ends e USING (id) GROUP BY lang UNION ALL SELECT 'coverage', 'all', round(avg((e.id IS NOT NULL)::INT), 6) FROM nodes n LEFT JOIN ends e USING (id)""")  # fmt: skip
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.alignment_stats(D.concept_nodes(spark, d), D.concept_edges(spark, d))


@query(sql("graph") + """, more AS (SELECT source, target, type FROM edges UNION ALL SELECT id, lang || '_src1', 'PREREQUISITE' FROM nodes WHERE i = 3 UNION ALL SELECT id, lang || '_src6', 'ALIGNED_WITH' FROM nodes WHERE i = 5),
reach AS (SELECT source, target FROM more WHERE type = 'PREREQUISITE' UNION SELECT r.source, e.target FROM reach r JOIN more e ON r.target = e.source AND e.type = 'PREREQUISITE')
SELECT 'aligned_within_language' AS rule, source, target FROM more JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE more.type = 'ALIGNED_WITH' AND a.lang = b.lang
UNION ALL SELECT 'prerequisite_cycle', e.source, e.target FROM (SELECT DISTINCT source, target FROM more WHERE type = 'PREREQUISITE') e WHERE EXISTS (FROM reach r WHERE r.source = e.target AND r.target = e.source)
UNION ALL SELECT 'prerequisite_harder', source, target FROM (SELECT DISTINCT source, target FROM more WHERE type = 'PREREQUISITE') JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.i * 7 % 5 > b.i * 7 % 5""")  # fmt: skip
def ontology_violations(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("id", "[0-9]+$", 0).cast("int")
    n = D.concept_nodes(spark, d).withColumn("difficulty", (number * 7 % 5).cast("string"))
    back = n.where(number == 3).select(F.col("id").alias("source"), F.concat("lang", F.lit("_src1")).alias("target"), F.lit("PREREQUISITE").alias("type"))
    same = n.where(number == 5).select(F.col("id").alias("source"), F.concat("lang", F.lit("_src6")).alias("target"), F.lit("ALIGNED_WITH").alias("type"))
    e = D.concept_edges(spark, d).select("source", "target", "type").unionByName(back).unionByName(same)
    return graph.ontology_violations(n, e)


LETTERS = lambda x: f"list_distinct(string_split(lower({x}), ''))"
JACCARD = lambda a, b: f"len(list_intersect({LETTERS(a)}, {LETTERS(b)}))::DOUBLE / len(list_distinct(list_concat({LETTERS(a)}, {LETTERS(b)})))"


@query(sql("graph") + f""", m AS (SELECT DISTINCT n_name AS mention FROM nation UNION SELECT DISTINCT p_name FROM part), s AS (SELECT mention, id, seq, round({JACCARD('mention', 'name')}, 9) AS similarity FROM m, nodes WHERE type = 'CONCEPT')
SELECT mention, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, seq)::INT AS rank FROM s WHERE similarity >= 0.4) WHERE rank <= 5""")  # fmt: skip
def fuzzy_link(spark: SparkSession, d: str) -> DataFrame:
    return linking.fuzzy(names_to_link(spark, d), D.concept_nodes(spark, d)).select("mention", "id", *r6("similarity"), "rank")


def names_to_link(spark: SparkSession, d: str) -> DataFrame:
    m = D.table(spark, d, "nation").select(F.col("n_name").alias("mention")).union(D.table(spark, d, "part").select("p_name")).distinct()
    return m.select("mention", F.lit("auto").alias("lang"), F.lit("CONCEPT").alias("type"))


@query(sql("graph") + f""", m AS (SELECT DISTINCT mention FROM (SELECT source || ' ' || lang AS mention FROM documents WHERE doc_id >= 0 UNION ALL SELECT source || ' e' FROM documents UNION ALL SELECT source FROM documents)),
ex AS (SELECT mention, arg_min(id, seq) AS id FROM m JOIN nodes ON mention = name GROUP BY mention),
near AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY seq) AS n FROM (SELECT * FROM m ANTI JOIN ex USING (mention)) JOIN nodes ON contains(name, mention)),
fz AS (SELECT *, round({JACCARD('mention', 'name')}, 9) AS confidence FROM near WHERE n <= 5)
SELECT mention, id, 1.0::DOUBLE AS confidence, 'exact' AS method FROM ex UNION ALL SELECT mention, id, round(confidence, 6), 'fuzzy' FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, seq) AS r FROM fz WHERE confidence >= 0.8) WHERE r = 1""")  # fmt: skip
def exact_then_fuzzy_link(spark: SparkSession, d: str) -> DataFrame:
    t = D.table(spark, d, "documents")
    m = t.select(F.concat_ws(" ", "source", "lang").alias("mention")).union(t.select(F.concat("source", F.lit(" e")))).union(t.select("source")).distinct()
    return linking.exact_then_fuzzy(m, D.concept_nodes(spark, d)).select("mention", "id", *r6("confidence"), "method")


@query(sql("graph") + " SELECT source, target, type, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, type)::INT AS rank FROM edges WHERE type IN ('PREREQUISITE', 'RELATED_TO')) WHERE rank <= 3")
def neighbors_topn(spark: SparkSession, d: str) -> DataFrame:
    return expand.neighbours(D.concept_edges(spark, d), 3, ["PREREQUISITE", "RELATED_TO"], by_weight=True).select("source", "target", "type", *r6("weight"), "rank")


SEEDS = "seeds AS (SELECT qid AS seed, id FROM questions JOIN nodes ON id = 'en_src' || (qid % 20))"
HOPS = f"""{SEEDS}, walk AS (SELECT seed, id, 0 AS hop FROM seeds UNION SELECT seed, e.target, hop + 1 FROM walk JOIN edges e ON e.source = walk.id WHERE hop < 2),
firsts AS (SELECT seed, id, min(hop) AS hop FROM walk GROUP BY ALL),
expanded AS (SELECT seed, (hop + 1)::INT AS hop, source, target, type, weight FROM firsts JOIN edges ON source = id WHERE hop < 2)"""
HOPS_SQL = sql("graph", "questions") + f", {HOPS}"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    q = D.questions(spark, d).select(F.col("qid").alias("seed"), F.concat(F.lit("en_src"), F.col("qid") % 20).alias("id"))
    return q.join(D.concept_nodes(spark, d).select("id"), "id", "left_semi").select("seed", "id")


def expanded(spark: SparkSession, d: str) -> DataFrame:
    return expand.hops(seeds(spark, d), D.concept_edges(spark, d))


@query(HOPS_SQL + " SELECT seed, hop, source, target, type, round(weight, 6) AS weight FROM expanded")
def hop_expand(spark: SparkSession, d: str) -> DataFrame:
    return expanded(spark, d).select("seed", "hop", "source", "target", "type", *r6("weight"))


@query(HOPS_SQL + " SELECT seed, hop, source, target, expanded.type, round(weight, 6) AS weight FROM expanded JOIN nodes ON target = id AND nodes.type = 'CONCEPT' WHERE weight >= 0.5")
def hop_expand_constrained(spark: SparkSession, d: str) -> DataFrame:
    return expand.constrained(expanded(spark, d), D.concept_nodes(spark, d), ["CONCEPT"], 0.5).select("seed", "hop", "source", "target", "type", *r6("weight"))


@query(sql("graph") + """, links AS (SELECT DISTINCT source, target FROM edges), p AS (SELECT id AS start, id AS node, [id] AS path FROM nodes WHERE lang = 'de' UNION ALL SELECT start, target, list_append(path, target) FROM p JOIN links ON node = source WHERE len(path) <= 3 AND NOT list_contains(path, target)),
best AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS r FROM p WHERE len(path) > 1)
SELECT start, node AS "end", (len(path) - 1)::INT AS length, array_to_string(path, '>') AS path FROM best WHERE r = 1 AND node LIKE 'en%'""")  # fmt: skip
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    n = D.concept_nodes(spark, d)
    found = expand.shortest(n.where("lang = 'de'").select(F.col("id").alias("start")), n.where("lang = 'en'").select(F.col("id").alias("end")), D.concept_edges(spark, d), 3)
    return found.select("start", "end", "length", F.array_join("path", ">").alias("path"))


PATHS = f"""{HOPS}, paths AS (SELECT seed, hop, source, target, round(exp(-0.5::DOUBLE * hop) * (0.8::DOUBLE * weight + 0.2::DOUBLE * (CASE type WHEN 'PREREQUISITE' THEN 1.0 WHEN 'EQUIVALENT' THEN 0.9 WHEN 'RELATED_TO' THEN 0.8 WHEN 'PART_OF' THEN 0.7 WHEN 'IS_A' THEN 0.6 ELSE 0.5 END)::DOUBLE), 9) AS score, type, weight FROM expanded),
node_scores AS (SELECT seed, id, max(score) AS score FROM (SELECT seed, source AS id, score FROM paths UNION ALL SELECT seed, target, score FROM paths) GROUP BY ALL)"""
PATHS_SQL = sql("graph", "questions", "corpus") + f", {PATHS}"
KG_RUN = "kg AS (SELECT seed AS qid, doc_id, max(score) AS score FROM node_scores JOIN corpus ON concept = id WHERE score > 0 GROUP BY ALL), kg_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM kg) WHERE rank <= 50)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return expand.scored_paths(expand.edge_paths(expanded(spark, d)))


def kg_run(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return expand.document_run(expand.node_scores(paths(spark, d)), D.corpus(spark, d), k)


@query(PATHS_SQL + " SELECT seed, hop AS length, source, target, round(score, 6) AS score FROM paths")
def kg_path_score(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("seed", "length", F.col("node_ids")[0].alias("source"), F.col("node_ids")[1].alias("target"), *r6("score"))


@query(PATHS_SQL + " SELECT seed, id, round(score, 6) AS score FROM node_scores")
def kg_node_score(spark: SparkSession, d: str) -> DataFrame:
    return expand.node_scores(paths(spark, d)).select("seed", "id", *r6("score"))


@query(PATHS_SQL + f", {KG_RUN} SELECT qid, doc_id, rank, round(score, 6) AS score FROM kg_run")
def kg_doc_score(spark: SparkSession, d: str) -> DataFrame:
    return kg_run(spark, d).select("qid", "doc_id", "rank", *r6("score"))


@query(PATHS_SQL + f", {KG_RUN}, {BM25}, re AS (SELECT qid, doc_id, round(0.5::DOUBLE * coalesce(k.score, 0) + 0.5::DOUBLE * s.score, 9) AS score FROM sparse_run s LEFT JOIN kg k USING (qid, doc_id)) SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM re")
def kg_rerank(spark: SparkSession, d: str) -> DataFrame:
    run = kept(sparse.bm25(D.corpus(spark, d), D.questions(spark, d), 50))
    docs = D.corpus(spark, d).select("doc_id", "concepts").join(run.select("doc_id").distinct(), "doc_id", "left_semi")
    return expand.reranked(run, expand.document_scores(expand.node_scores(paths(spark, d)), docs)).select("qid", "doc_id", *r6("score"), "rank")


# ---- fusion

PARTS = f"""{PATHS}, {KG_RUN}, {BM25}, {HASHED},
parts AS (SELECT qid, doc_id, 'dense' AS source, score, rank FROM hash_run UNION ALL SELECT qid, doc_id, 'sparse', score, rank FROM sparse_run UNION ALL SELECT qid, doc_id, 'kg', score, rank FROM kg_run),
normed AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-6 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM parts WINDOW w AS (PARTITION BY qid, source)),
wide AS (SELECT qid, doc_id, coalesce(max(norm) FILTER (source = 'dense'), 0) AS dense, coalesce(max(norm) FILTER (source = 'sparse'), 0) AS sparse, coalesce(max(norm) FILTER (source = 'kg'), 0) AS kg FROM normed GROUP BY ALL),
ranks AS (SELECT qid, doc_id, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'dense'), 0) AS dense, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'sparse'), 0) AS sparse, coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (source = 'kg'), 0) AS kg FROM parts GROUP BY ALL)"""
PARTS_SQL = sql("graph", "questions", "corpus") + f", {PARTS}"


def fused_sql(source: str, score: str) -> str:
    return f", fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_score DESC, doc_id)::INT AS rank FROM (SELECT qid, doc_id, round({score}, 9) AS fused_score, dense, sparse, kg FROM {source}))"


SUM = "0.4::DOUBLE * dense + 0.3::DOUBLE * sparse + 0.3::DOUBLE * kg"
FUSED = "SELECT qid, doc_id, rank, round(fused_score, 6) AS fused_score FROM fused"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Component scores of the three sources for each question, 50 candidates each."""
    return fusion.components(hash_run(spark, d), sparse.bm25(D.corpus(spark, d), D.questions(spark, d), 50), kg_run(spark, d))


def fused(spark: SparkSession, d: str, method: str) -> DataFrame:
    return fusion.fuse(parts(spark, d), method).select("qid", "doc_id", "rank", *r6("fused_score"))


@query(PARTS_SQL + fused_sql("wide", SUM) + FUSED)
def fusion_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, "weighted_sum")


@query(PARTS_SQL + fused_sql("ranks", SUM) + FUSED)
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, "rrf")


@query(PARTS_SQL + fused_sql("wide", "greatest(0.4::DOUBLE * dense, 0.3::DOUBLE * sparse, 0.3::DOUBLE * kg)") + FUSED)
def fusion_max(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, "max")


@query(PARTS_SQL + fused_sql("wide", SUM) + " SELECT qid, doc_id, rank, source, round(score, 6) AS score, weight, round(score * weight, 6) AS contribution FROM (SELECT qid, doc_id, rank, unnest([{'source': 'dense', 'score': dense, 'weight': 0.4::DOUBLE}, {'source': 'sparse', 'score': sparse, 'weight': 0.3::DOUBLE}, {'source': 'kg', 'score': kg, 'weight': 0.3::DOUBLE}], recursive := true) FROM fused WHERE rank <= 10)")
def fusion_explain(spark: SparkSession, d: str) -> DataFrame:
    return fusion.explained(fusion.fuse(parts(spark, d), k=10)).select("qid", "doc_id", "rank", "source", *r6("score"), "weight", *r6("contribution"))


@query(PARTS_SQL + fused_sql("wide", SUM) + " SELECT qid, doc_id, rank, round(fused_score, 6) AS fused_score, md5(title) AS title_md5, lang FROM fused JOIN corpus USING (doc_id) WHERE rank <= 10")
def search_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.fuse(parts(spark, d), k=10)
    return fusion.enriched(found, D.corpus(spark, d)).select("qid", "doc_id", "rank", *r6("fused_score"), F.md5("title").alias("title_md5"), "lang")


TRIPLES = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in config.ABLATION)


@query(PARTS_SQL + f""", triples(run, wd, ws, wk) AS (VALUES {TRIPLES}), each AS (SELECT run, qid, doc_id, norm * (CASE source WHEN 'dense' THEN wd WHEN 'sparse' THEN ws ELSE wk END) AS x FROM normed, triples WHERE (CASE source WHEN 'dense' THEN wd WHEN 'sparse' THEN ws ELSE wk END) > 0),
runs AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT run, qid, doc_id, round(sum(x), 9) AS score FROM each GROUP BY ALL)),
rel AS (SELECT qid, doc_id FROM questions, corpus WHERE contains(content, query)), ideal AS (SELECT qid, count(*) AS n, sum(1 / log2(i + 1.0::DOUBLE)) FILTER (i <= 10) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid) AS i FROM rel) GROUP BY qid),
per AS (SELECT run, qid, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rel.doc_id IS NOT NULL AND rank <= 10), 0) AS dcg, coalesce(max(1.0::DOUBLE / rank) FILTER (rel.doc_id IS NOT NULL), 0) AS mrr, count(*) FILTER (rel.doc_id IS NOT NULL AND rank <= 50) AS hits FROM (FROM runs WHERE rank <= 100) r LEFT JOIN rel USING (qid, doc_id) GROUP BY ALL)
SELECT run, round(avg(dcg / idcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(hits / n::DOUBLE), 6) AS recall, count(*) AS num_evaluated FROM per JOIN ideal USING (qid) GROUP BY run""")  # fmt: skip
def ablation(spark: SparkSession, d: str) -> DataFrame:
    runs = fusion.ablation(parts(spark, d)).withColumn("qid0", F.col("qid")).withColumn("qid", F.struct("run", "qid"))
    rel = contains_qrels(spark, d)
    names = spark.createDataFrame([(n,) for n, *_ in config.ABLATION], "run string")
    each = rel.join(F.broadcast(names)).select(F.struct("run", "qid").alias("qid"), "doc_id", "rel")
    scores = metrics.per_query(runs.select("qid", "doc_id", "rank"), each)
    return scores.groupBy("qid.run").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("num_evaluated"))


def contains_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a question's text are relevant. Candidates hold its first five words as a run, so that only those are searched."""
    from marlstone.functions.columns import words

    docs = D.corpus(spark, d).select("doc_id", "content")
    held = docs.select("doc_id", words(F.col("content")).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))
    # a text may begin within a word, so its first whole run is the one after the first word, and it may end within one
    q = D.questions(spark, d).withColumn("w", words(F.col("query")))
    long = q.where(F.size("w") >= 7).select("qid", "query", F.xxhash64(F.array_join(F.slice("w", 2, 5), " ")).alias("h"))
    short = q.where(F.size("w") < 7).select("qid", "query")
    hit = held.select("doc_id", F.explode(F.array_distinct(runs)).alias("h")).join(long, "h").select("qid", "doc_id", "query").distinct()
    hit = hit.join(docs, "doc_id").where(F.col("content").contains(F.col("query"))).select("qid", "doc_id")
    if not short.isEmpty():
        asked, held_ = short.select("qid", F.col("query").alias("mention")), docs.select("doc_id", F.col("content").alias("name"))
        hit = hit.unionByName(linking.containing(asked, held_).select("qid", "doc_id"))
    return hit.withColumn("rel", F.lit(1))


# ---- extraction

REL_SQL = [(r, ("(?i)" if f else "") + p.replace(r"\w", r"[\pL\pM\pN\p{Pc}]").replace(r"\S", r"[^\s]").replace("'", "''")) for r, f, p in extract.PATTERNS]
TALK = "talk AS (SELECT conv_id * 1000 + turn AS doc_id, role || ' requires ' || split_part(text, ' ', 1) || ' and ' || split_part(text, ' ', 2) || ' relates to ' || text AS content FROM conversations)"


@query(f"WITH {TALK}, found AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS relation, unnest(list_zip(regexp_extract_all(content, '{p}', 1), regexp_extract_all(content, '{p}', 2))) AS x FROM talk" for r, p in REL_SQL) + ") SELECT DISTINCT doc_id, relation, x[1] AS source, x[2] AS target, 0.8::DOUBLE AS confidence, 'rule' AS method FROM found")
def relation_extract(spark: SparkSession, d: str) -> DataFrame:
    c = D.table(spark, d, "conversations")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    talk = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat("role", F.lit(" requires "), word(1), F.lit(" and "), word(2), F.lit(" relates to "), "text").alias("content"))
    return extract.relations(talk)


@query(f"""WITH talk AS (SELECT conv_id * 1000 + turn AS doc_id, text AS content FROM conversations), words AS (SELECT DISTINCT doc_id, content, unnest(regexp_extract_all(lower(content), '{WORD}')) AS word FROM talk),
names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM benchmark) SELECT doc_id, 'xx' AS lang, word AS text, 'Concept' AS type, 1.0::DOUBLE AS score, (instr(lower(content), word) - 1)::INT AS "start", (instr(lower(content), word) - 1 + length(word))::INT AS "end" FROM words JOIN names USING (word)""")  # fmt: skip
def gazetteer_entities(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.functions.columns import words

    talk = D.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("xx").alias("lang"), F.col("text").alias("content"))
    names = D.table(spark, d, "benchmark").select(F.explode(words(F.col("text"))).alias("name")).distinct().withColumn("type", F.lit("Concept"))
    return extract.gazetteer(talk, names)


# ---- alignment


def entities(spark: SparkSession, d: str) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, ("fr", "en", "zh"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return D.vectors(spark, d).select(F.concat_ws("_", lang, F.col("doc_id").cast("string")).alias("entity"), "vector", "doc_id")


ENTITIES = "ents AS (SELECT ['fr', 'en', 'zh'][doc_id % 3 + 1] || '_' || doc_id AS entity, vector, doc_id FROM vectors)"


@query(sql("vectors") + f", {ENTITIES}, s AS (SELECT a.entity AS source, b.entity AS target, round(list_distance(a.vector, b.vector), 9) AS distance FROM ents a, ents b WHERE a.doc_id % 20 = 0) SELECT source, target, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target)::INT AS rank FROM s) WHERE rank <= 5")
def align_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    return align.nearest_l2(e, e.where("doc_id % 20 = 0")).select("source", "target", F.round(F.abs("distance"), 6).alias("distance"), "rank")


@query(sql("vectors") + f", {ENTITIES}, s AS (SELECT a.entity AS source, b.entity AS target, round(list_cosine_similarity(a.vector, b.vector), 9) AS similarity FROM ents a, ents b WHERE a.doc_id % 20 = 0 AND b.entity LIKE 'zh@_%' ESCAPE '@') SELECT source, target, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target)::INT AS rank FROM s) WHERE rank <= 5")
def align_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    return align.nearest_cosine(e, e.where("doc_id % 20 = 0"), "zh").select("source", "target", *r6("similarity"), "rank")


@query(sql("vectors") + f", {ENTITIES} SELECT count(*) AS pairs, round(avg(list_distance(a.vector, b.vector)), 6) AS mean_distance FROM ents a JOIN ents b ON b.doc_id = a.doc_id + 1")
def align_seed_distance(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    seeds_ = e.select("entity", "doc_id").join(e.select(F.col("entity").alias("entity2"), (F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.col("entity").alias("entity1"), "entity2")
    return align.seed_distance(e, seeds_)


@query()
def align_train(spark: SparkSession, d: str) -> DataFrame:
    return align.trained(D.concept_edges(spark, d))


# ---- learners


def mastery_table(spark: SparkSession, d: str) -> DataFrame:
    return learner.mastery(D.learner_events(spark, d).where("event_type <> 'query'"), NOW)


@query(sql("learner") + " SELECT learner_id, concept_id, round(mastery, 6) AS mastery FROM mastery")
def mastery(spark: SparkSession, d: str) -> DataFrame:
    return mastery_table(spark, d).select("learner_id", "concept_id", *r6("mastery"))


LEVEL = "CASE WHEN mastery >= 0.8 THEN 'mastered' WHEN mastery >= 0.5 THEN 'familiar' WHEN mastery >= 0.2 THEN 'learning' ELSE 'novice' END"


@query(sql("learner") + f" SELECT {LEVEL} AS level, count(*) AS n FROM mastery GROUP BY 1")
def mastery_levels(spark: SparkSession, d: str) -> DataFrame:
    return mastery_table(spark, d).groupBy(learner.level(F.col("mastery")).alias("level")).agg(F.count("*").alias("n"))


WEAK = "weak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY mastery, concept_id)::INT AS rank FROM mastery WHERE mastery < 0.6) WHERE rank <= 5)"


@query(sql("learner") + f", {WEAK} SELECT learner_id, concept_id, round(mastery, 6) AS mastery, rank FROM weak")
def weak_concepts(spark: SparkSession, d: str) -> DataFrame:
    return learner.weak(mastery_table(spark, d), 0.6, 5).select("learner_id", "concept_id", *r6("mastery"), "rank")


@query(sql("learner") + """, own AS (SELECT learner_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'practice') AS practices, sum(duration) AS study, count(DISTINCT concept_id) AS concepts FROM learner WHERE event_type <> 'query' GROUP BY 1),
hours AS (SELECT learner_id, arg_min(hour, -n * 100 + hour) AS favourite_hour FROM (SELECT learner_id, floor((ts % 86400) / 3600)::INT AS hour, count(*) AS n FROM learner GROUP BY ALL) GROUP BY 1)
SELECT learner_id, views, practices, round(practices / greatest(views + practices, 1)::DOUBLE, 6) AS practice_ratio, round(views / greatest(views + practices, 1)::DOUBLE, 6) AS view_ratio, round(study / greatest(concepts, 1), 4) AS avg_study_time, favourite_hour FROM own JOIN hours USING (learner_id)""")  # fmt: skip
def learning_preferences(spark: SparkSession, d: str) -> DataFrame:
    return learner.preferences(D.learner_events(spark, d))


PROFILE = f"""profile AS (SELECT learner_id, concepts, avg_mastery, mastered, familiar, learning, novice, study_time, last_active, 0 AS session_count FROM
(SELECT learner_id, count(*) AS concepts, round(avg(mastery), 6) AS avg_mastery, count(*) FILTER (l = 'mastered') AS mastered, count(*) FILTER (l = 'familiar') AS familiar, count(*) FILTER (l = 'learning') AS learning, count(*) FILTER (l = 'novice') AS novice FROM (SELECT *, {LEVEL} AS l FROM mastery) GROUP BY 1)
JOIN (SELECT learner_id, round(sum(CASE WHEN event_type <> 'query' THEN duration ELSE 0 END), 4) AS study_time, arg_max(ts, seq) AS last_active FROM learner GROUP BY 1) USING (learner_id))"""


@query(sql("learner") + f", {PROFILE} SELECT * FROM profile")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return learner.summary(D.learner_events(spark, d), mastery_table(spark, d))


@query(sql("learner") + f""", {PROFILE}, {WEAK} SELECT 'total' AS kind, 'learners' AS name, count(*)::DOUBLE AS value FROM profile UNION ALL SELECT 'total', 'avg_mastery', round(avg(avg_mastery), 6) FROM profile UNION ALL SELECT 'total', 'avg_concepts', round(avg(concepts), 6) FROM profile
UNION ALL (SELECT 'weak', concept_id, count(*)::DOUBLE FROM weak GROUP BY concept_id ORDER BY count(*) DESC, concept_id LIMIT 10)""")  # fmt: skip
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    scores = mastery_table(spark, d)
    return learner.cohort(learner.summary(D.learner_events(spark, d), scores), learner.weak(scores, 0.6, 5))


NEEDS = "needs AS (SELECT 'c' || i AS concept, 'c' || (i - 1) AS needs FROM range(1, 10) r(i) UNION ALL SELECT 'c' || i, 'c' || (i // 2) FROM range(4, 10) r(i) WHERE i // 2 <> i - 1)"


def needs_table(spark: SparkSession) -> DataFrame:
    rows = [(f"c{i}", f"c{i - 1}") for i in range(1, 10)] + [(f"c{i}", f"c{i // 2}") for i in range(4, 10) if i // 2 != i - 1]
    return spark.createDataFrame(rows, "concept string, needs string")


def closure_table(spark: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    targets = learner.weak(scores, 0.6, 5).select("learner_id", F.col("concept_id").alias("concept"))
    return learner.closure(targets, needs_table(spark), scores)


@query(sql("learner") + f", {WEAK}, {NEEDS}, walk AS (SELECT learner_id, concept_id AS concept FROM weak UNION SELECT w.learner_id, n.needs FROM walk w JOIN needs n USING (concept) LEFT JOIN mastery m ON m.learner_id = w.learner_id AND m.concept_id = w.concept WHERE coalesce(m.mastery, 0) < 0.7) SELECT learner_id, concept FROM walk")
def prereq_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure_table(spark, d, mastery_table(spark, d))


@query()
def learning_path(spark: SparkSession, d: str) -> DataFrame:
    scores = mastery_table(spark, d)
    return learner.learning_path(closure_table(spark, d, scores), needs_table(spark), scores)


@query(sql("learner") + f""", {PROFILE}, own AS (SELECT learner_id, count(*) FILTER (event_type = 'practice') / greatest(count(*), 1)::DOUBLE AS r FROM learner WHERE event_type <> 'query' GROUP BY 1)
SELECT learner_id, CASE WHEN avg_mastery < 0.3 THEN 'build_basics' WHEN avg_mastery < 0.6 THEN 'keep_going' ELSE 'advance' END AS overall, CASE WHEN round(r, 6) < 0.3 THEN 'practise_more' WHEN round(r, 6) > 0.7 THEN 'read_more' ELSE 'balanced' END AS tip,
CASE WHEN study_time / 3600 < 10 THEN 'more_time' ELSE 'enough_time' END AS time_advice FROM profile JOIN own USING (learner_id)""")  # fmt: skip
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    events = D.learner_events(spark, d)
    profile = learner.summary(events, mastery_table(spark, d)).join(learner.preferences(events).select("learner_id", "practice_ratio"), "learner_id")
    return learner.recommendations(profile).select("learner_id", "overall", "tip", "time_advice")


@query(sql("corpus") + f" SELECT count(*) FILTER (length({CLEAN('content')}) BETWEEN 50 AND 10000) AS valid, count(*) FILTER (NOT length({CLEAN('content')}) BETWEEN 50 AND 10000) AS invalid FROM corpus")
def corpus_validity(spark: SparkSession, d: str) -> DataFrame:
    return T.validity_counts(D.corpus(spark, d))


@query("WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_quantity AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) SELECT source, target, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY seq DESC, weight DESC) AS r FROM e) WHERE r = 1")
def graph_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.upsert(e, ["source", "target", "type"]).select("source", "target", "type", "weight")


@query(sql("corpus") + " SELECT concept AS concept_id, count(*) AS views, sum(length(content))::BIGINT AS duration FROM corpus WHERE concept IS NOT NULL GROUP BY 1")
def resource_views(spark: SparkSession, d: str) -> DataFrame:
    views = D.corpus(spark, d).select(F.lit(1).cast("long").alias("learner_id"), "concepts", F.lit(0.0).alias("ts"), F.col("doc_id").alias("seq"), F.length("content").alias("duration"))
    return learner.viewed(views).groupBy("concept_id").agg(F.count("*").alias("views"), F.sum("duration").alias("duration"))


# ---- search from end to end, with linking


LINKED = f"seeds AS (SELECT qid AS seed, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, seq) AS r FROM (SELECT qid, id, seq, round({JACCARD('query', 'name')}, 9) AS similarity FROM questions, nodes WHERE type = 'CONCEPT') WHERE similarity >= 0.2) WHERE r = 1)"
FOUND = " SELECT qid, doc_id, rank, round(fused_score, 6) AS fused_score, lang FROM fused JOIN corpus USING (doc_id) WHERE rank <= 10"


@query(sql("graph", "questions") + f", {LINKED} SELECT seed AS qid, id FROM seeds")
def link_queries(spark: SparkSession, d: str) -> DataFrame:
    return search.link_queries(D.questions(spark, d), D.concept_nodes(spark, d), threshold=0.2).select("qid", "id")


@query(PARTS_SQL.replace(SEEDS, LINKED) + fused_sql("wide", SUM) + FOUND)
def search_linked(spark: SparkSession, d: str) -> DataFrame:
    held = search.Graph(D.concept_nodes(spark, d), D.concept_edges(spark, d))
    return search.search(D.questions(spark, d), D.corpus(spark, d), held, threshold=0.2).select("qid", "doc_id", "rank", *r6("fused_score"), "lang")


@query(PARTS_SQL + fused_sql("wide", "0.4::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE) * dense + 0.3::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE) * sparse") + FOUND)
def search_without_graph(spark: SparkSession, d: str) -> DataFrame:
    held = search.Graph(D.concept_nodes(spark, d), D.concept_edges(spark, d))
    return search.search(D.questions(spark, d), D.corpus(spark, d), held, use_kg=False, explain=True).select("qid", "doc_id", "rank", *r6("fused_score"), "lang")


def _baselines_sql() -> str:
    metrics_ = EVAL[EVAL.index("hits AS") :]
    one = lambda name, run: f"SELECT '{name}' AS run, * FROM (WITH {metrics_.replace('dense_run', run)} SELECT round(avg(ap), 6) AS map, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS \"ndcg@10\", round(avg(precision), 6) AS \"precision@10\", round(avg(recall), 6) AS \"recall@50\" FROM evaluated)"
    fused_ = fused_sql("wide", "0.4::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE) * dense + 0.3::DOUBLE / (0.4::DOUBLE + 0.3::DOUBLE) * sparse")
    no_kg = PARTS_SQL.replace(" UNION ALL SELECT qid, doc_id, 'kg', score, rank FROM kg_run", "")
    rel = ", qrels AS (SELECT qid, doc_id, 1 AS rel FROM questions, corpus WHERE contains(content, query)), full_run AS (SELECT qid, doc_id, rank FROM fused WHERE rank <= 100) "
    return no_kg + fused_ + rel + " UNION ALL ".join(one(n, r) for n, r in (("dense_only", "hash_run"), ("sparse_only", "sparse_run"), ("full", "full_run")))


@query(_baselines_sql())
def eval_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Baselines of the indexes there are; the graph's is missing here, so the full run goes without it."""
    found = search.runs(D.questions(spark, d), D.corpus(spark, d)) | {"kg": None}
    out = search.evaluated(found, contains_qrels(spark, d))
    return out.select("run", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ("map", "mrr", "ndcg@10", "precision@10", "recall@50")])


@query()
def pq_topk(spark: SparkSession, d: str) -> DataFrame:
    cells, centres = dense.build_cells(D.vectors(spark, d), nlist=CELLS)
    coded, books = dense.build_codes(cells, centres)
    return dense.probe_codes(coded, centres, books, D.vector_queries(spark, d), 10, PROBED)


def stored_vectors(spark: SparkSession, d: str, path: str) -> vectorindex.VectorIndex:
    """Three quarters of the vectors, the rest inserted, cells of more than a fortieth split, and cells enough for most neighbours."""
    index, vectors = vectorindex.VectorIndex(spark, path), D.vectors(spark, d).select("doc_id", "vector")
    later = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    index.build(vectors.where(~later), nlist=CELLS)
    index.insert(vectors.where(later))
    index.split(max(10, vectors.count() // 40))
    index.calibrate(0.97)
    return index


@query()
def stored_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as path:
        return scratch.held(stored_vectors(spark, d, path).search(D.vector_queries(spark, d).select("qid", "vector")))


#: The trade graph's edges after two imports: other weights for the edges of parts whose number is below 100, which are neighbours, and edges to a new node.
MERGED = sql("trade") + """ SELECT source, target, type, round(CASE WHEN source LIKE 'p%' AND substr(source, 2)::INT < 100 THEN weight + 1 ELSE weight END, 6) AS weight FROM edges
UNION ALL SELECT 'p' || p_partkey, 'new', 'MADE', round(p_size / 50.0::DOUBLE, 6) FROM part WHERE p_partkey < 100"""


@query(MERGED)
def edges_merged(spark: SparkSession, d: str) -> DataFrame:
    edges = D.trade_edges(spark, d).select("source", "target", "type", "weight")
    part = F.expr("try_cast(substr(source, 2) AS int)")
    with scratch(spark) as path:
        stored = keyed.KeyedTable(spark, path, ("source", "target", "type"))
        stored.create(edges, file_rows=1000)
        stored.merge(edges.where(F.col("source").startswith("p") & (part < 100)).withColumn("weight", F.col("weight") + 1))
        made = D.table(spark, d, "part").where("p_partkey < 100").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), F.lit("new").alias("target"), F.lit("MADE").alias("type"), (F.col("p_size") / 50.0).alias("weight"))
        stored.insert(made)
        return scratch.held(stored.read().select("source", "target", "type", *r6("weight")))


# ---- learners: goals and reports


@query()
def goal_path(spark: SparkSession, d: str) -> DataFrame:
    scores = mastery_table(spark, d)
    goals = scores.select("learner_id").distinct().withColumn("concept", F.concat(F.lit("c"), (F.col("learner_id") % 12).cast("string")))  # c10 and c11 are no concepts
    return learner.goal_path(goals, needs_table(spark), scores)


@query(sql("learner") + f""", {PROFILE}, {WEAK}, own AS (SELECT learner_id, count(*) FILTER (event_type = 'practice') / greatest(count(*), 1)::DOUBLE AS r FROM learner WHERE event_type <> 'query' GROUP BY 1),
w AS (SELECT learner_id, count(*)::INT AS n_weak, arg_min(concept_id, rank) AS weakest FROM weak GROUP BY 1)
SELECT learner_id, concepts, avg_mastery, CASE WHEN avg_mastery < 0.3 THEN 'build_basics' WHEN avg_mastery < 0.6 THEN 'keep_going' ELSE 'advance' END AS overall,
CASE WHEN round(r, 6) < 0.3 THEN 'practise_more' WHEN round(r, 6) > 0.7 THEN 'read_more' ELSE 'balanced' END AS tip, coalesce(n_weak, 0) AS n_weak, weakest FROM profile JOIN own USING (learner_id) LEFT JOIN w USING (learner_id)""")  # fmt: skip
def learner_report(spark: SparkSession, d: str) -> DataFrame:
    out = learner.report(D.learner_events(spark, d), needs_table(spark), NOW)
    return out.select("learner_id", "concepts", "avg_mastery", "overall", "tip", F.coalesce(F.size("weak_concepts"), F.lit(0)).alias("n_weak"), F.get("weak_concepts", F.lit(0))["concept_id"].alias("weakest"))


@query(sql("learner") + " SELECT learner_id, floor((ts % 86400) / 3600)::INT AS hour, count(*) AS n FROM learner GROUP BY ALL")
def active_hours(spark: SparkSession, d: str) -> DataFrame:
    return learner.active_hours(D.learner_events(spark, d))


@query(sql("learner") + " SELECT learner_id, CASE seq % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'unknown' END AS lang, count(*) AS n FROM learner WHERE event_type = 'query' GROUP BY ALL")
def query_languages(spark: SparkSession, d: str) -> DataFrame:
    asked = D.learner_events(spark, d).where("event_type = 'query'")
    return learner.query_languages(asked.withColumn("lang", F.when(F.col("seq") % 3 == 0, "fr").when(F.col("seq") % 3 == 1, "en")))


# ---- graphs from entities, imports


@query("""WITH e AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' x' END AS name, n_regionkey AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b, CASE WHEN n_nationkey % 3 = 0 THEN 'LOCATION' END AS type FROM nation),
m AS (SELECT name, CASE WHEN a % 2 = 0 THEN 'fr' ELSE 'unknown' END AS lang, coalesce(type, 'CONCEPT') AS type, a, b FROM e) SELECT lang || '_' || type || '_' || lpad((row_number() OVER (PARTITION BY type ORDER BY a, b) - 1)::VARCHAR, 6, '0') AS id, name, lang, type, a::VARCHAR AS source_doc FROM m""")  # fmt: skip
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = D.table(spark, d, "nation")
    one = F.struct(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("entity"), F.concat("n_name", F.lit(" x")).alias("text"), F.when(F.col("n_nationkey") % 3 == 0, "LOCATION").alias("type"))
    batches = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(one)).alias("entities"))
    batches = batches.select(F.col("n_regionkey").alias("doc_id"), F.when(F.col("n_regionkey") % 2 == 0, "fr").alias("lang"), "entities", F.col("n_regionkey").alias("seq"))
    return graph.nodes(graph.mentions_of(batches)).select("id", "name", "lang", "type", "source_doc")


@query("""WITH n AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT p_partkey + 1000000, p_name FROM part WHERE p_partkey % 5 <> 0),
e AS (SELECT l_suppkey AS source, l_partkey + 1000000 AS target, l_returnflag AS type, l_quantity AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT source, target, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY seq DESC, weight DESC) AS r FROM e SEMI JOIN n a ON a.id = e.source SEMI JOIN n b ON b.id = e.target) WHERE r = 1""")  # fmt: skip
def graph_import(spark: SparkSession, d: str) -> DataFrame:
    s, p, e = (D.table(spark, d, n) for n in ("supplier", "part", "lineitem"))
    nodes_ = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).union(p.where("p_partkey % 5 <> 0").select(F.col("p_partkey") + 1000000, "p_name")).withColumn("seq", F.lit(0))
    edges_ = e.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.imported(nodes_, edges_)[1].select("source", "target", "type", "weight")


@query(sql("graph") + " SELECT a.name AS name, edges.type AS type, b.name AS target FROM (FROM edges ORDER BY seq LIMIT 5) edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target")
def graph_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency_sample(D.concept_nodes(spark, d), D.concept_edges(spark, d))


@query(sql("vectors") + f", {ENTITIES}, r AS (SELECT vector FROM vectors WHERE doc_id = 0) SELECT a.entity AS source, b.entity AS target, round(sqrt(list_sum(list_transform(list_zip(a.vector, b.vector, (SELECT vector FROM r)), lambda x: (x[1] + x[3] - x[2]) ** 2))), 6) AS score FROM ents a JOIN ents b ON b.doc_id = a.doc_id + 1")
def translation_scores(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    pairs = e.select("entity", "doc_id").join(e.select(F.col("entity").alias("target"), (F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.col("entity").alias("source"), F.lit("NEXT").alias("type"), "target")
    kinds = e.where("doc_id = 0").select(F.lit("NEXT").alias("type"), "vector")
    return align.translation_scores(pairs, e, kinds).select("source", "target", *r6("score"))


# ---- files, written and read back


@query(sql("corpus") + " SELECT doc_id::VARCHAR AS doc_id, lang, md5(title) AS title_md5, md5(content) AS content_md5, concept FROM corpus WHERE content <> ''")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as folder:
        rows = D.corpus(spark, d).where("content <> ''").withColumn("doc_id", F.col("doc_id").cast("string"))
        sinks.json_lines(rows, f"{folder}/corpus_xx_cleaned.jsonl")
        back = readers.corpus(spark, readers.corpus_files(spark, folder), strict=True)
        return scratch.held(back.select("doc_id", "lang", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), F.array_join("concepts", ",").alias("concept")))


@query(sql("corpus", "questions") + f", {BM25} SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, rank FROM sparse_run WHERE rank <= 10")
def run_files(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as folder:
        sinks.run(sparse.bm25(D.corpus(spark, d), D.questions(spark, d)), f"{folder}/run.trec", "trec", "BM25")
        return scratch.held(readers.run(spark, f"{folder}/run.trec"))


@query(sql("graph") + " SELECT 'node' AS kind, id AS a, name AS b, type, NULL::DOUBLE AS weight FROM nodes UNION ALL SELECT 'edge', source, target, type, round(weight, 6) FROM edges")
def graph_files(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as folder:
        sinks.json_lines(D.concept_nodes(spark, d).select("id", "name", "lang", "type"), f"{folder}/nodes.jsonl")
        sinks.json_lines(D.concept_edges(spark, d).select("source", "target", "type", F.struct("weight").alias("properties")), f"{folder}/edges.jsonl")
        n = readers.nodes(spark, f"{folder}/nodes.jsonl").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), "type", F.lit(None).cast("double").alias("weight"))
        e = readers.edges(spark, f"{folder}/edges.jsonl").select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "type", F.round("weight", 6).alias("weight"))
        return scratch.held(n.unionByName(e))


# ---- a graph that grows with the tables


@query(sql("trade") + f", {DEGREES} SELECT round(avg(n_in) FILTER (n_in > 0), 6) AS avg_in, max(n_in) AS max_in, round(avg(n_out) FILTER (n_out > 0), 6) AS avg_out, max(n_out) AS max_out, (SELECT count(*) FROM nodes ANTI JOIN deg USING (id)) AS isolated FROM deg")
def trade_degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_stats(D.trade_nodes(spark, d), D.trade_edges(spark, d))


@query(sql("trade") + f", {DEGREES} SELECT id, n_in, n_out, degree, name, lang, type FROM (SELECT *, n_in + n_out AS degree FROM deg ORDER BY degree DESC, id LIMIT 10) JOIN nodes USING (id)")
def trade_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_nodes(D.trade_nodes(spark, d), D.trade_edges(spark, d))


@query(sql("trade") + " SELECT source, target, type, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, type)::INT AS rank FROM edges WHERE type IN ('A', 'N')) WHERE rank <= 3")
def trade_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return expand.neighbours(D.trade_edges(spark, d), 3, ["A", "N"], by_weight=True).select("source", "target", "type", *r6("weight"), "rank")


TRADE_HOPS = f""", limited AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS r FROM edges) WHERE r <= 5), seeds AS (SELECT id AS seed, id FROM nodes WHERE type = 'SUPPLIER' AND substr(id, 2)::INT % 10 = 0),
{HOPS[len(SEEDS) + 2 :]}""".replace("JOIN edges", "JOIN limited")


def trade_expanded(spark: SparkSession, d: str) -> DataFrame:
    seeds_ = D.trade_nodes(spark, d).where("type = 'SUPPLIER' AND cast(substr(id, 2) AS INT) % 10 = 0").select(F.col("id").alias("seed"), "id")
    return expand.hops(seeds_, D.trade_edges(spark, d), fan_out=5)


@query(sql("trade") + TRADE_HOPS + " SELECT seed, hop, source, target, type, round(weight, 6) AS weight FROM expanded")
def trade_hops(spark: SparkSession, d: str) -> DataFrame:
    return trade_expanded(spark, d).select("seed", "hop", "source", "target", "type", *r6("weight"))


@query(sql("trade") + TRADE_HOPS + ", paths AS (SELECT seed, source, target, round(exp(-0.5::DOUBLE * hop) * (0.8::DOUBLE * weight + 0.2::DOUBLE * 0.5::DOUBLE), 9) AS score FROM expanded) SELECT seed, id, round(max(score), 6) AS score FROM (SELECT seed, source AS id, score FROM paths UNION ALL SELECT seed, target, score FROM paths) GROUP BY ALL")
def trade_node_score(spark: SparkSession, d: str) -> DataFrame:
    return expand.node_scores(expand.scored_paths(expand.edge_paths(trade_expanded(spark, d)))).select("seed", "id", *r6("score"))


#: Links of the trade graph that lead one way: from suppliers to parts that were accepted, from parts to suppliers to which they came back, in large lots.
FLOWS = sql("trade") + ", links AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE weight >= 0.9 AND ((type = 'A' AND source LIKE 's%') OR (type = 'R' AND source LIKE 'p%')))"


def trade_flows(spark: SparkSession, d: str) -> DataFrame:
    accepted, returned = (F.col("type") == "A") & F.col("source").startswith("s"), (F.col("type") == "R") & F.col("source").startswith("p")
    return D.trade_edges(spark, d).where("weight >= 0.9").where(accepted | returned)


@query(FLOWS + REACH)
def trade_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(D.trade_nodes(spark, d), trade_flows(spark, d))


@query(FLOWS.replace("links AS", "one AS") + ", links AS (SELECT a, b FROM one UNION SELECT b, a FROM one)" + REACH)
def trade_wcc(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(D.trade_nodes(spark, d), trade_flows(spark, d))


@query(FLOWS + ", walk AS (SELECT id AS a, id AS b FROM nodes UNION SELECT walk.a, l.b FROM walk JOIN links l ON walk.b = l.a), labels AS (SELECT x.a AS id, min(n.seq) AS label FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a JOIN nodes n ON n.id = x.b GROUP BY 1) SELECT id, label FROM labels")
def trade_strong(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_labels(D.trade_nodes(spark, d), trade_flows(spark, d))
