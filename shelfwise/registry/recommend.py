"""Neighbours, content candidates, blends and their evaluation."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise.operators import aggregates as A
from shelfwise.operators import als as L
from shelfwise.operators import evaluation as E
from shelfwise.operators import factors as M
from shelfwise.operators import hybrid as H
from shelfwise.operators import interactions as I
from shelfwise.operators import neighbours as N
from shelfwise.operators.content import content_candidates, similar_products
from shelfwise.operators.ranking import top_n
from shelfwise.registry.core import define, query
from shelfwise.registry.tables import CUT_DAY, behavior
from shelfwise.registry.views import view
from shelfwise.session import cut_lineage, stored


def neighbour_sql(prefix: str, source: str, needs: tuple[str, ...]) -> None:
    """Definitions of the neighbours and predictions over a table of scored interactions."""
    define(f"{prefix}_pos", f"SELECT user_id, product_id, interaction_score AS x FROM {source} "
           "WHERE interaction_score > 0", needs)
    define(f"{prefix}_unit", f"""
SELECT user_id, product_id, x, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS w FROM {prefix}_pos""",
           (f"{prefix}_pos",))
    define(f"{prefix}_ranked", f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, neighbour_id) AS rank FROM (
  SELECT a.user_id, b.user_id AS neighbour_id, round(sum(a.w * b.w), 9) AS similarity
  FROM {prefix}_unit a JOIN {prefix}_unit b ON a.product_id = b.product_id AND a.user_id <> b.user_id
  GROUP BY 1, 2)""", (f"{prefix}_unit",))
    define(f"{prefix}_predicted", f"""
SELECT n.user_id, p.product_id, sum(similarity * x) AS cf_score
FROM {prefix}_ranked n JOIN {prefix}_pos p ON p.user_id = n.neighbour_id
WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM {prefix}_pos s WHERE s.user_id = n.user_id AND s.product_id = p.product_id)
GROUP BY 1, 2 HAVING sum(similarity * x) > 0""", (f"{prefix}_ranked",))
    define(f"{prefix}_cf", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(cf_score, 9) DESC, product_id) AS rank
  FROM {prefix}_predicted) WHERE rank <= 10""", (f"{prefix}_predicted",))


neighbour_sql("all", "behavior", ("behavior",))


@query("user_similarity", """
SELECT user_id, neighbour_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM all_ranked WHERE rank <= 10""", ("all_ranked",))
def _(spark, sf):
    return N.user_similarity(cut_lineage(behavior(spark, sf))).withColumn("similarity", F.round("similarity", 6))


# The larger graph of customers and parts: long sparse profiles, most products rare.
neighbour_sql("bought", "purchases", ("purchases",))


@query("customer_similarity", """
SELECT user_id, neighbour_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM bought_ranked WHERE rank <= 10""", ("bought_ranked",))
def _(spark, sf):
    return N.user_similarity(stored(D.purchases(spark, sf), "purchases")).withColumn("similarity", F.round("similarity", 6))


@query("co_interaction_self_join", """
SELECT n.user_id, n.neighbour_id, count(*) AS shared_products
FROM all_ranked n JOIN all_pos a ON a.user_id = n.user_id
JOIN all_pos b ON b.user_id = n.neighbour_id AND b.product_id = a.product_id
GROUP BY 1, 2""", ("all_ranked",))
def _(spark, sf):
    return N.co_interaction(cut_lineage(behavior(spark, sf)))


@query("knn_recommend", """
SELECT user_id, product_id, round(cf_score, 6) AS cf_score, CAST(rank AS INTEGER) AS rank FROM all_cf""", ("all_cf",))
def _(spark, sf):
    return N.knn_recommend(cut_lineage(behavior(spark, sf))).withColumn("cf_score", F.round("cf_score", 6))


GRID = [(k, t) for k in N.SWEEP_K for t in N.SWEEP_THRESHOLD]


@query("knn_sweep", """
WITH_GRID AS (SELECT unnest([5, 10, 20]) AS k), thresholds AS (SELECT unnest([0.2, 0.3, 0.4]::DOUBLE[]) AS threshold),
hits AS (SELECT DISTINCT k, threshold, n.user_id, p.product_id
  FROM all_ranked n JOIN all_pos p ON p.user_id = n.neighbour_id, ks, thresholds
  WHERE n.rank <= k AND n.similarity >= threshold AND NOT EXISTS
    (SELECT 1 FROM all_pos s WHERE s.user_id = n.user_id AND s.product_id = p.product_id)),
lengths AS (SELECT k, threshold, user_id, least(count(*), 10) AS n FROM hits GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, threshold,
  round(coalesce((SELECT sum(n) FROM lengths l WHERE l.k = ks.k AND l.threshold = thresholds.threshold), 0)
        / (SELECT count(DISTINCT user_id) FROM behavior), 6) AS avg_recommendations
FROM ks, thresholds""".replace("WITH_GRID", ", ks"), ("all_ranked", "behavior"))
def _(spark, sf):
    swept = N.knn_sweep(cut_lineage(behavior(spark, sf)))
    return swept.withColumn("avg_recommendations", F.round("avg_recommendations", 6))


def blend_sql(prefix: str, source: str, cf: str) -> None:
    """Definitions of content candidates and blend over a table of interactions."""
    define(f"{prefix}cb", f"""
SELECT user_id, similar_id AS product_id, max(similarity) AS cb_score
FROM {source} JOIN alike USING (product_id) GROUP BY 1, 2""", (source, "alike"))
    define(f"{prefix}merged", f"""
SELECT user_id, product_id, coalesce(cb_score, 0.0) AS cb_score, coalesce(cf_score, 0.0) AS cf_score
FROM (SELECT user_id, product_id, cb_score / max(cb_score) OVER (PARTITION BY user_id) AS cb_score FROM {prefix}cb)
FULL JOIN (SELECT user_id, product_id, cf_score / max(cf_score) OVER (PARTITION BY user_id) AS cf_score FROM {cf})
USING (user_id, product_id)""", (f"{prefix}cb", cf))
    define(f"{prefix}blended", f"""
SELECT *, 0.7::DOUBLE * cf_score + 0.3::DOUBLE * cb_score AS hybrid_score FROM {prefix}merged m
WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE s.user_id = m.user_id AND s.product_id = m.product_id)""", (f"{prefix}merged",))
    define(f"{prefix}hybrid", f"""
SELECT b.*, name, price, rating, popularity_score, hybrid_score * popularity_score AS recommendation_score
FROM (SELECT * FROM {prefix}blended QUALIFY
  row_number() OVER (PARTITION BY user_id ORDER BY round(hybrid_score, 9) DESC, product_id) <= 10) b
JOIN products USING (product_id)""", (f"{prefix}blended", "products"))


blend_sql("", "behavior", "all_cf")

# Factors, power steps and the numbers that the start values are made of.
MF_RANK, MF_STEPS = 4, 3
START_FACTOR, START_MODULUS = 7368787, 1000003


def start_value(product_id, j):
    return ((product_id + 1) * ((j + 2) * START_FACTOR) % START_MODULUS + 0.5) / START_MODULUS - 0.5


def mf_sql(prefix: str, source: str) -> None:
    """Definitions ``{prefix}mf`` of the factorisation's top lists: the power steps as joins and sums."""
    define(f"{prefix}cells", f"SELECT user_id, product_id, interaction_score AS x FROM {source} WHERE interaction_score <> 0", (source,))
    define(f"{prefix}b0", f"""
SELECT product_id, j, ((product_id + 1) * ((j + 2) * {START_FACTOR}) % {START_MODULUS} + 0.5::DOUBLE) / {START_MODULUS} - 0.5::DOUBLE AS w
FROM (SELECT DISTINCT product_id FROM {prefix}cells), range({MF_RANK}) AS t(j)""", (f"{prefix}cells",))
    for step in range(MF_STEPS):
        now, image = f"{prefix}b{step}", f"{prefix}i{step}"
        define(image, f"""
SELECT product_id, j, sum(x * y) AS w FROM {prefix}cells JOIN (
  SELECT user_id, j, sum(x * w) AS y FROM {prefix}cells JOIN {now} USING (product_id) GROUP BY user_id, j) USING (user_id)
GROUP BY product_id, j""", (now,))
        for j in range(MF_RANK):
            before = [f"{prefix}o{step}_{i}" for i in range(j)]
            less = "".join(
                f" - coalesce((SELECT o.w FROM {o} o WHERE o.product_id = i.product_id), 0)"
                f" * (SELECT sum(o.w * k.w) FROM {o} o JOIN {image} k USING (product_id) WHERE k.j = {j})" for o in before)
            define(f"{prefix}o{step}_{j}", f"""
SELECT product_id, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT product_id, w{less} AS w FROM {image} i WHERE j = {j})""", (image, *before))
        define(f"{prefix}b{step + 1}", " UNION ALL ".join(
            f"SELECT product_id, CAST({j} AS BIGINT) AS j, w FROM {prefix}o{step}_{j}" for j in range(MF_RANK)),
            tuple(f"{prefix}o{step}_{j}" for j in range(MF_RANK)))
    last = f"{prefix}b{MF_STEPS}"
    define(f"{prefix}mf", f"""
SELECT user_id, product_id, mf_score FROM (
  SELECT u.user_id, v.product_id, round(sum(u.y * v.w) / (any_value(u.n) * any_value(v.n)), 9) AS mf_score
  FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY user_id)) AS n FROM (
          SELECT user_id, j, sum(x * w) AS y FROM {prefix}cells JOIN {last} USING (product_id) GROUP BY user_id, j)) u
  JOIN (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS n FROM {last}) v USING (j)
  GROUP BY u.user_id, v.product_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mf_score DESC, product_id) <= 10""", (last,))


mf_sql("", "behavior")


def mf_lists(behavior, n=10):
    """Top products per user by the cosine of fixed-step factors."""
    users, items = M.power_factors(M.matrix(behavior), MF_RANK, MF_STEPS, start_value)
    return M.factor_cosine_top(users, items, n)


@query("mf_lists", "SELECT user_id, product_id, round(mf_score, 6) AS mf_score FROM mf", ("mf",))
def _(spark, sf):
    return mf_lists(behavior(spark, sf)).withColumn("mf_score", F.round("mf_score", 6))


def _similar(spark, sf):
    touched = D.events(spark, sf).select("product_id").distinct()
    return similar_products(D.catalog_text(spark, sf), touched)


@query("content_candidates", "SELECT user_id, product_id, round(cb_score, 6) AS cb_score FROM cb", ("cb",))
def _(spark, sf):
    found = content_candidates(behavior(spark, sf), _similar(spark, sf))
    return found.withColumn("cb_score", F.round("cb_score", 6))


@query("max_normalise", """
SELECT user_id, product_id,
  round(interaction_score / nullif(max(interaction_score) OVER (PARTITION BY user_id), 0), 6) AS interaction_score
FROM behavior""", ("behavior",))
def _(spark, sf):
    scores = behavior(spark, sf).drop("action_frequency")
    return H.max_normalise(scores, "interaction_score").withColumn(
        "interaction_score", F.round("interaction_score", 6)
    )


@query("merge_candidates", """
SELECT user_id, product_id, round(cb_score, 6) AS cb_score, round(cf_score, 6) AS cf_score FROM merged""", ("merged",))
def _(spark, sf):
    b = cut_lineage(behavior(spark, sf))
    # Each is read for its largest scores, too.
    cb, cf = cut_lineage(content_candidates(b, _similar(spark, sf))), cut_lineage(N.knn_recommend(b))
    merged = H.merge_candidates(H.max_normalise(cb, "cb_score"), H.max_normalise(cf, "cf_score"))
    return merged.withColumns({c: F.round(c, 6) for c in ("cb_score", "cf_score")})


HYBRID_COLUMNS = ("cb_score", "cf_score", "hybrid_score", "rating", "popularity_score", "recommendation_score")
HYBRID_SQL = "SELECT user_id, product_id, name, price, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in HYBRID_COLUMNS) + " FROM hybrid"


@query("hybrid_blend", HYBRID_SQL, ("hybrid",))
def _(spark, sf):
    b = cut_lineage(behavior(spark, sf))
    cb = content_candidates(b, _similar(spark, sf))
    blended = H.hybrid_blend(b, D.products(spark, sf), cb, N.knn_recommend(b))
    return blended.withColumns({c: F.round(c, 6) for c in HYBRID_COLUMNS})


@query("hybrid_all_users", HYBRID_SQL, ("hybrid",))
def _(spark, sf):
    lists = H.hybrid_all_users(behavior(spark, sf), D.products(spark, sf), D.catalog_text(spark, sf))
    return lists.withColumns({c: F.round(c, 6) for c in HYBRID_COLUMNS})


define("three_scores", """
SELECT user_id, product_id, coalesce(cf_score, 0.0) AS cf_score, coalesce(mf_score, 0.0) AS mf_score, coalesce(cb_score, 0.0) AS cb_score
FROM merged m FULL JOIN (
  SELECT user_id, product_id, CASE WHEN max(mf_score) OVER (PARTITION BY user_id) > 0
    THEN mf_score / max(mf_score) OVER (PARTITION BY user_id) ELSE 0 END AS mf_score FROM mf) USING (user_id, product_id)
WHERE NOT EXISTS (SELECT 1 FROM behavior s WHERE s.user_id = user_id AND s.product_id = product_id)""".replace(
    "s.user_id = user_id AND s.product_id = product_id", "(s.user_id, s.product_id) = (coalesce(m.user_id, mf.user_id), coalesce(m.product_id, mf.product_id))").replace(
    "FROM mf) USING", "FROM mf) mf USING"), ("merged", "mf"))
SWEEP = [{"cf_score": a, "mf_score": b, "cb_score": c} for a, b, c in H.SWEEP_WEIGHTS]


@query("blend_sweep", "SELECT setting, user_id, product_id, round(blend, 6) AS blend, CAST(rank AS INTEGER) AS rank FROM ("
       "SELECT *, row_number() OVER (PARTITION BY setting, user_id ORDER BY round(blend, 9) DESC, product_id) AS rank "
       "FROM (" + " UNION ALL ".join(
           f"SELECT CAST({i} AS INTEGER) AS setting, user_id, product_id, {s['cf_score']}::DOUBLE * cf_score"
           f" + {s['mf_score']}::DOUBLE * mf_score + {s['cb_score']}::DOUBLE * cb_score AS blend FROM three_scores"
           for i, s in enumerate(SWEEP)) + ")) WHERE rank <= 10", ("three_scores",))
def _(spark, sf):
    b = cut_lineage(behavior(spark, sf))
    cb = content_candidates(b, _similar(spark, sf))
    cf = N.knn_recommend(b).select(*I.PAIR, "cf_score")
    each = {"cf_score": cf, "mf_score": mf_lists(b), "cb_score": cb}
    scores = H.merge_scores(*(H.max_normalise(cut_lineage(df), name) for name, df in each.items()))
    return H.blend_sweep(cut_lineage(I.exclude_seen(scores, b)), SWEEP).withColumn("blend", F.round("blend", 6))


ALGORITHMS = ("cf", "mf", "hybrid")
define("lists", """
SELECT user_id, product_id, algorithm, score, score * popularity_score AS recommendation_score FROM (
  SELECT user_id, product_id, 'cf' AS algorithm, cf_score AS score FROM all_cf
  UNION ALL SELECT user_id, product_id, 'mf', mf_score FROM mf
  UNION ALL SELECT user_id, product_id, 'hybrid', hybrid_score FROM hybrid)
JOIN products USING (product_id)""", ("all_cf", "mf", "hybrid"))


def _named(**scored):
    """Lists below one another as (algorithm, user_id, product_id, score)."""
    rows = [df.select(F.lit(name).alias("algorithm"), *I.PAIR, F.col(f"{name}_score").alias("score")) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, rows)


def _lists(spark, sf):
    b, products = cut_lineage(behavior(spark, sf)), cut_lineage(D.products(spark, sf))
    cf = cut_lineage(N.knn_recommend(b))
    hybrid = H.hybrid_blend(b, products, content_candidates(b, _similar(spark, sf)), cf)
    rows = _named(cf=cf, mf=mf_lists(b), hybrid=hybrid).join(products.select("product_id", "popularity_score"), "product_id")
    # Stored once: the range sort of the view reads its rows twice.
    return cut_lineage(rows.withColumn("recommendation_score", F.col("score") * F.col("popularity_score")).drop("popularity_score"))


def lists(spark, sf):
    """Recommendations of three algorithms in long form, stored by user."""
    return view(spark, sf, "lists", "user_id", _lists, [F.col("algorithm"), F.desc("score")])


@query("algorithm_comparison", "SELECT user_id, " + ", ".join(
    f"round(avg(CASE WHEN algorithm = '{a}' THEN recommendation_score END), 6) AS {a}" for a in ALGORITHMS
) + " FROM lists GROUP BY user_id", ("lists",))
def _(spark, sf):
    compared = A.algorithm_comparison(lists(spark, sf).all(), ALGORITHMS)
    return compared.withColumns({a: F.round(a, 6) for a in ALGORITHMS})


@query("comparison_of", "SELECT user_id, " + ", ".join(
    f"round(avg(CASE WHEN algorithm = '{a}' THEN recommendation_score END), 6) AS {a}" for a in ALGORITHMS
) + " FROM lists WHERE user_id = 8 GROUP BY user_id", ("lists",))
def _(spark, sf):
    compared = A.algorithm_comparison(lists(spark, sf).of(8), ALGORITHMS)
    return compared.withColumns({a: F.round(a, 6) for a in ALGORITHMS})


@query("compare_algorithms", """
SELECT algorithm, product_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, algorithm ORDER BY round(score, 9) DESC, product_id) AS rank
  FROM lists WHERE score IS NOT NULL) WHERE rank <= 5 AND user_id = 8""", ("lists",))
def _(spark, sf):
    return E.compare_algorithms(lists(spark, sf).of(8), ALGORITHMS).select(
        "algorithm", "product_id", F.round("score", 6).alias("score"), "rank"
    )


@query("product_score_table", """
SELECT *, CASE WHEN hybrid >= cf AND hybrid >= mf THEN 'hybrid' WHEN cf >= mf THEN 'cf' ELSE 'mf' END AS best_algorithm
FROM (SELECT user_id, product_id, """ + ", ".join(
    f"round(coalesce(max(CASE WHEN algorithm = '{a}' THEN score END), 0.0), 6) AS {a}" for a in ALGORITHMS
) + " FROM lists GROUP BY user_id, product_id)", ("lists",))
def _(spark, sf):
    rows = lists(spark, sf).all().withColumn("score", F.round("score", 6))
    return E.product_score_table(rows, ALGORITHMS)


# Hold-out: lists drawn from the days before the cut, compared with positive actions after it.
define("train_behavior", f"""
SELECT user_id, product_id, count(*) AS action_frequency, sum(action_weight) AS interaction_score
FROM weighted WHERE ts < TIMESTAMP '{CUT_DAY}' GROUP BY 1, 2""", ("weighted",))
neighbour_sql("train", "train_behavior", ("train_behavior",))
define("relevant", f"""
SELECT DISTINCT user_id, product_id FROM weighted WHERE ts >= TIMESTAMP '{CUT_DAY}' AND action_weight > 0""",
       ("weighted",))
blend_sql("train_", "train_behavior", "train_cf")
mf_sql("train_", "train_behavior")
define("train_lists", """
SELECT 'cf' AS algorithm, user_id, product_id FROM train_cf
UNION ALL SELECT 'mf', user_id, product_id FROM train_mf
UNION ALL SELECT 'hybrid', user_id, product_id FROM train_hybrid
UNION ALL SELECT 'popularity', user_id, product_id FROM (SELECT user_id, product_id, row_number() OVER (
  PARTITION BY user_id ORDER BY round(interaction_score * popularity_score, 9) DESC, product_id) AS rank
  FROM train_behavior JOIN products USING (product_id)) WHERE rank <= 10""", ("train_cf", "train_mf", "train_hybrid", "products"))


@query("ranking_metrics", """
, held AS (SELECT user_id, count(*) AS held FROM relevant GROUP BY 1),
per_user AS (SELECT algorithm, l.user_id, count(*) AS listed, count(r.user_id) AS hits
  FROM train_lists l LEFT JOIN relevant r ON r.user_id = l.user_id AND r.product_id = l.product_id GROUP BY 1, 2),
sums AS (SELECT algorithm, sum(hits / listed) / (SELECT count(*) FROM held) AS p,
  sum(hits / held) / (SELECT count(*) FROM held) AS r, count(*) / (SELECT count(*) FROM held) AS c
  FROM per_user JOIN held USING (user_id) GROUP BY 1)
SELECT algorithm, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(c, 6) AS user_coverage FROM sums""",
       ("relevant", "train_lists"))
def _(spark, sf):
    listed, _, positive = held_out(spark, sf)
    return rounded_metrics(E.ranking_metrics(listed, positive))


def held_out(spark, sf):
    """(lists drawn from the days before the cut, their interactions, positive actions after it)."""
    events, products = D.events(spark, sf), D.products(spark, sf)
    cut = F.to_timestamp_ntz(F.lit(f"{CUT_DAY} 00:00:00"))
    train = cut_lineage(I.interactions(events.where(F.col("ts") < cut)))
    popularity = top_n(I.popularity_baseline(train, products), "user_id", "recommendation_score", "product_id", 10)
    cf = cut_lineage(N.knn_recommend(train))
    cb = content_candidates(train, similar_products(D.catalog_text(spark, sf), train.select("product_id").distinct()))
    listed = _named(
        cf=cf, mf=mf_lists(train), hybrid=H.hybrid_blend(train, products, cb, cf), popularity=popularity)
    positive = events.where((F.col("ts") >= cut) & (F.col("action") != "other")).select(*I.PAIR).distinct()
    return listed.drop("score"), train, positive


def rounded_metrics(metrics):
    return metrics.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "user_coverage")})


@query("ranking_metrics_of_all")
def _(spark, sf):
    """The same for every recommender; the numbers of fitted ones depend on their solver."""
    listed, train, positive = held_out(spark, sf)
    ratings, users, items = L.indexed(train)
    als = L.als_recommend_all(L.als_fit(ratings), users, items, D.products(spark, sf)).withColumnRenamed("cf_score", "als_score")
    fitted = {f"{m}_score": M.mf_recommend(train, D.products(spark, sf), m).withColumnRenamed("mf_score", f"{m}_score") for m in ("svd", "nmf")}
    more = _named(als=als, svd=fitted["svd_score"], nmf=fitted["nmf_score"]).drop("score")
    return rounded_metrics(E.ranking_metrics(listed.unionByName(more), positive))
