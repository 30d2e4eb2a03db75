"""Fitted models. Their numbers depend on the solver, so they carry no checking SQL."""

from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise.operators import als as L
from shelfwise.operators import factors as M
from shelfwise.registry.core import query
from shelfwise.registry.tables import behavior


@query("train_test_split")
def _(spark, sf):
    train, test = L.train_test_split(behavior(spark, sf), ["user_id", "product_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _fitted(spark, sf):
    ratings, users, items = L.indexed(behavior(spark, sf))
    train, test = L.train_test_split(ratings, ["user_index", "item_index"])
    return L.als_fit(train), test, users, items


@query("als_fit")
def _(spark, sf):
    return _fitted(spark, sf)[0].userFactors


@query("als_rmse")
def _(spark, sf):
    model, test, _, _ = _fitted(spark, sf)
    return L.als_rmse(model, test)


@query("als_recommend_all")
def _(spark, sf):
    model, _, users, items = _fitted(spark, sf)
    return L.als_recommend_all(model, users, items, D.products(spark, sf))


@query("mf_sweep")
def _(spark, sf):
    ratings, _, _ = L.indexed(behavior(spark, sf))
    return L.sweep_table(L.mf_sweep(ratings), ratings)


@query("svd_factors")
def _(spark, sf):
    users, _, _ = M.svd_factors(M.matrix(behavior(spark, sf)))
    return users


@query("nmf_factors")
def _(spark, sf):
    users, _, _ = M.nmf_factors(M.matrix(behavior(spark, sf)))
    return users


@query("factor_cosine_score")
def _(spark, sf):
    users, items, _ = M.svd_factors(M.matrix(behavior(spark, sf)))
    return M.factor_cosine_top(users, items)


@query("svd_recommend")
def _(spark, sf):
    return M.mf_recommend(behavior(spark, sf), D.products(spark, sf), "svd")


@query("nmf_recommend")
def _(spark, sf):
    return M.mf_recommend(behavior(spark, sf), D.products(spark, sf), "nmf")
