"""Queries of retrieval quality."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from graphquarry.functions import vectors as vx
from graphquarry.operators import evaluation as e
from graphquarry.operators import statistics as st
from graphquarry.operators import search as s

from .registry import query

_RANKED = """r AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, file_id) AS rank FROM sims JOIN files USING (vec_id)), ranked AS (SELECT * FROM r WHERE rank <= 10)"""
_METRICS = f"""{_RANKED}, want AS (SELECT query_id, count(*) AS n FROM expected GROUP BY 1),
 h AS (SELECT r.query_id, count(*) AS returned, count(*) FILTER (WHERE rank <= 5 AND x.file_id IS NOT NULL) AS top5, count(x.file_id) AS found, min(rank) FILTER (WHERE x.file_id IS NOT NULL) AS first,
   sum(1 / log2(rank + 1)) FILTER (WHERE x.file_id IS NOT NULL) AS dcg FROM ranked r LEFT JOIN expected x ON r.query_id = x.query_id AND r.file_id = x.file_id GROUP BY 1),
 m AS (SELECT query_id, CASE WHEN n IS NULL THEN (coalesce(returned, 0) = 0)::INT ELSE coalesce(top5 / 5, 0) END AS p5, CASE WHEN n IS NULL THEN (coalesce(returned, 0) = 0)::INT ELSE coalesce(top5 / least(5, n), 0) END AS hit5,
   CASE WHEN n IS NULL THEN (coalesce(returned, 0) = 0)::INT ELSE coalesce(found / n, 0) END AS recall, CASE WHEN n IS NULL THEN (coalesce(returned, 0) = 0)::INT ELSE coalesce(1 / first, 0) END AS mrr,
   CASE WHEN n IS NULL THEN (coalesce(returned, 0) = 0)::INT ELSE coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 0) END AS ndcg10 FROM h FULL JOIN want USING (query_id))"""


def ranked(v):
    rows = v.files.select("file_id", "vec_id").join(vx.good_vectors(v.table("embeddings"), 64), "vec_id").drop("vec_id")
    hits = vx.best_pairs(vx.spread_rows(rows), vx.ask(v.queries, v.table("embeddings"), 64), 10, 64)
    order = s.Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "file_id")
    return hits.select("query_id", "file_id", F.row_number().over(order).alias("rank")).filter("rank <= 10")


@query("eval_metrics", f"WITH {_METRICS} SELECT query_id, round(p5, 6)::DOUBLE AS p5, round(hit5, 6)::DOUBLE AS hit5, round(recall, 6)::DOUBLE AS recall, round(mrr, 6)::DOUBLE AS mrr, round(ndcg10, 6)::DOUBLE AS ndcg10 FROM m")
def _(v):
    return e.metrics(ranked(v), v.expected).select("query_id", *[F.round(n, 6).alias(n) for n in e.NAMES])


@query("eval_means", f"WITH {_METRICS} SELECT round(avg(p5), 6) AS p5, round(avg(hit5), 6) AS hit5, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10, count(*) AS n_queries FROM m")
def _(v):
    return e.means(e.metrics(ranked(v), v.expected)).select(*[F.round(n, 6).alias(n) for n in e.NAMES], "n_queries")


@query("eval_gates", f"WITH {_METRICS}, a AS (SELECT avg(p5) AS p, avg(mrr) AS q, avg(ndcg10) AS g FROM m) SELECT 'p5' AS gate, p >= 0.15 AS passed FROM a UNION ALL SELECT 'mrr', q >= 0.5 FROM a UNION ALL SELECT 'ndcg', g >= 0.0 - 0.02 FROM a")
def _(v):
    return e.gates(e.means(e.metrics(ranked(v), v.expected)), 0.0)


@query("eval_diversity", f"WITH {_RANKED} SELECT query_id, count(DISTINCT file_id) AS n_files, count(DISTINCT dir_path) AS n_folders FROM ranked JOIN files USING (file_id) WHERE rank <= 5 GROUP BY query_id")
def _(v):
    return e.diversity(ranked(v), v.files)


@query("eval_dataset_paths", "SELECT e.query_id, count(*) AS n_expected, count(f.file_id) AS n_there FROM expected e LEFT JOIN files f USING (file_id) GROUP BY e.query_id")
def _(v):
    f = v.files.select("file_id", F.lit(1).alias("there"))
    return v.expected.join(f, "file_id", "left").groupBy("query_id").agg(F.count("*").alias("n_expected"), F.count("there").alias("n_there"))


_WORDS = """w AS (SELECT query_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: length(x) > 2))) AS l FROM queries),
 u AS (SELECT query_id, unnest(l) AS word FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(word) DESC, word) AS rn FROM u),
 h AS (SELECT DISTINCT file_id, unnest(regexp_split_to_array(lower(skeleton), '[^a-z0-9]+')) AS word FROM files),
 c AS (SELECT query_id, file_id, count(*) AS n_words FROM h JOIN k USING (word) WHERE rn <= 5 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, file_id) AS rank FROM c)"""


@query("keyword_baseline", f"WITH {_WORDS} SELECT query_id, file_id, n_words, rank FROM r WHERE rank <= 10")
def _(v):
    return e.keyword_baseline(v.files, v.queries).withColumn("rank", F.col("rank").cast("long"))


@query("longest_keywords", f"WITH {_WORDS} SELECT query_id, string_agg(word, ' ' ORDER BY rn) AS words FROM k WHERE rn <= 5 GROUP BY query_id")
def _(v):
    words = F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    longest = F.slice(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, 5)
    return v.queries.select("query_id", F.array_join(longest, " ").alias("words")).filter("words <> ''")


def _sweep_sql(configs: dict) -> str:
    """The engine's scores under each configuration, their ranks and metrics; the weights are those of LOW unless a configuration has its own."""
    from .search import BOOSTS, DIRS, LOW

    fields = ("alpha", "beta", "parent_multiplier", "hybrid", "length_weight", "min_score")
    rows = ", ".join(f"('{name}', {', '.join(str(float(c.get(f, getattr(LOW, f)))) + '::DOUBLE' for f in fields)})" for name, c in configs.items())
    return f"""{BOOSTS}, {DIRS}, cfg(config, alpha, beta, times, hybrid, weight, least) AS (VALUES {rows}),
 base AS (SELECT *, CASE WHEN file_type = '.md' THEN 0 ELSE greatest(0, ln(length(skeleton) / 4.0 / (SELECT avg(length(skeleton) / 4.0) FROM files WHERE length(skeleton) > 0))) END AS long FROM files),
 parts AS MATERIALIZED (SELECT m.query_id, f.file_id, f.file_type, m.sim, coalesce(b.commit_boost, 0) AS commit_boost, coalesce(d.dir_sim, 0) AS folder, f.long, coalesce(k.score / max(k.score) OVER (PARTITION BY m.query_id), 0) AS keyword
   FROM base f JOIN sims m ON f.vec_id = m.vec_id LEFT JOIN dirs d ON d.query_id = m.query_id AND d.repo_id = f.repo_id AND d.dir_path = f.dir_path
   LEFT JOIN boosts b ON b.query_id = m.query_id AND b.file_id = f.file_id LEFT JOIN bm25 k ON k.query_id = m.query_id AND k.file_id = f.file_id),
 sc AS (SELECT config, query_id, file_id, least, (1 - hybrid) * (sim + alpha * commit_boost - weight * long
     + CASE file_type WHEN '.go' THEN 0.35 WHEN '.java' THEN 0.1 WHEN '.py' THEN 0.25 ELSE beta END * CASE WHEN folder > least THEN folder * CASE file_type WHEN '.go' THEN 0.4 WHEN '.java' THEN 0.15 ELSE times END ELSE 0 END) + hybrid * keyword AS score FROM parts, cfg),
 r AS (SELECT config, query_id, file_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(score, 6) DESC, file_id) AS rank FROM sc WHERE score >= least),
 h AS (SELECT r.config, r.query_id, min(r.rank) FILTER (WHERE x.file_id IS NOT NULL) AS first, count(x.file_id) FILTER (WHERE rank <= 5) AS top5, count(x.file_id) AS found
   FROM r LEFT JOIN expected x ON r.query_id = x.query_id AND r.file_id = x.file_id WHERE rank <= 10 GROUP BY ALL),
 wq AS (SELECT config, query_id, n FROM cfg, (SELECT query_id, count(*) AS n FROM expected GROUP BY 1)),
 m AS (SELECT config, query_id, CASE WHEN n IS NULL THEN 0 ELSE coalesce(1 / first, 0) END AS mrr, CASE WHEN n IS NULL THEN 0 ELSE coalesce(top5 / 5, 0) END AS p5, CASE WHEN n IS NULL THEN 0 ELSE coalesce(found / n, 0) END AS recall FROM h FULL JOIN wq USING (config, query_id))"""


def swept(v, configs: dict):
    """The metrics of every query under each configuration."""
    from .search import LOW, batches

    every = [(name, replace(LOW, **c)) for name, c in configs.items()]
    names = v.spark.sql(f"SELECT explode(array({', '.join(repr(n) for n in configs)})) AS config")
    return e.metrics(batches(v).sweep(every), v.expected, ["config"], names)


@query("scoring_sweep", f"WITH {_sweep_sql(e.ABLATIONS)} SELECT config, round(avg(p5), 6) AS p5, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM m GROUP BY config")
def _(v):
    return e.means(swept(v, e.ABLATIONS), ["config"]).select("config", *[F.round(c, 6).alias(c) for c in ("p5", "recall", "mrr")], "n_queries")


@query("best_config", f"WITH {_sweep_sql(e.grid())}, a AS (SELECT config, round(avg(p5) + avg(mrr), 9) AS o FROM m GROUP BY config) SELECT config, round(o, 6) AS objective FROM a ORDER BY o DESC, config LIMIT 1")
def _(v):
    return e.best_config(e.means(swept(v, e.grid()), ["config"]))


_CAUSE = "CASE best_config " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in e.CAUSES.items()) + " END"


@query("regression_classes", f"""WITH {_sweep_sql(e.FORENSICS)}, b AS (SELECT query_id, mrr FROM m WHERE config = 'baseline'),
 o AS (SELECT query_id, config AS best_config, mrr, row_number() OVER (PARTITION BY query_id ORDER BY round(mrr, 9) DESC, list_position({list(e.FORENSICS)}, config)) AS rn FROM m WHERE config <> 'baseline')
 SELECT query_id, best_config, {_CAUSE} AS cause, round(o.mrr - b.mrr, 6) AS delta FROM b JOIN o USING (query_id) WHERE rn = 1 AND round(o.mrr - b.mrr, 9) >= 0.05""")
def _(v):
    return e.classify_changes(swept(v, e.FORENSICS), list(e.FORENSICS))


@query("latency_percentiles", "SELECT event_type, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95, list_sort(list(value))[floor(count(*) * 0.99)::INT + 1] AS p99, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def _(v):
    c = F.col("value")
    g = v.table("events").groupBy("event_type").agg(F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 4).alias("mean"))
    p = st.percentiles(v.table("events"), ["event_type"], "value", [0.5, 0.95, 0.99])
    p = p.groupBy("event_type").agg(*[F.max(F.when(F.col("share") == q, F.col("value"))).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    return g.join(p, "event_type").select("event_type", "p50", "p95", "p99", "low", "high", "mean")


@query("price_percentiles", """SELECT l_returnflag, l_linestatus, share, list_sort(list(l_extendedprice))[least(floor(count(*) * any_value(share))::BIGINT, count(*) - 1) + 1]::DOUBLE AS price, count(*) AS n
 FROM lineitem, (SELECT unnest([0.0, 0.1, 0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS share) GROUP BY ALL""")
def _(v):
    p = st.percentiles(v.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])
    return p.select("l_returnflag", "l_linestatus", "share", F.col("value").alias("price"), "n")


@query("model_costs", "SELECT r_name AS model, round(500 * 1000 * (r_regionkey + 1) * 0.02 / 1e6, 6)::DOUBLE AS per_1k_files FROM region")
def _(v):
    return v.table("region").select(F.col("r_name").alias("model"), F.round(500 * 1000 * (F.col("r_regionkey") + 1) * 0.02 / 1e6, 6).alias("per_1k_files"))
