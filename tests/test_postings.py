"""Searches over stored postings against a scan of all documents."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.operators import postings as O
from shelfwise.operators import search as S
from shelfwise.operators.ids import ordinal_ids


@pytest.fixture(scope="module")
def shop(spark):
    """A word in every document, some in few, ties and nulls of popularity, empty and null texts."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(40)]
    data = []
    for k in range(1500):
        name = "common " * int(rng.integers(1, 4)) + " ".join(rng.choice(words, rng.integers(0, 6), p=np.arange(40, 0, -1) / 820))
        place = rng.choice(["north", "south", "w3", ""])
        data.append((k, None if k % 50 == 7 else name, str(place), None if k % 40 == 3 else float(rng.integers(0, 300))))
    return spark.createDataFrame(data, "product_id long, name string, location string, popularity_score double").repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark, shop, tmp_path_factory):
    order = [F.desc_nulls_last("popularity_score"), F.col("product_id")]
    return O.build(shop, S.PRODUCT_FIELDS, str(tmp_path_factory.mktemp("index")), order, "popularity_score")


QUERIES = [["common"], ["w3"], ["w39", "w0"], ["common", "w5", "north"], ["absent"], ["absent", "w38"], ["south"]]


@pytest.mark.parametrize("terms", QUERIES)
def test_by_priority(shop, index, terms):
    expected = S.search_products(shop, " ".join(terms), 7).withColumn("relevance", F.round("relevance", 6))
    got = O.top_by_priority(index, terms, 7).withColumn("relevance", F.round("relevance", 6))
    assert rows(got, *expected.columns) == rows(expected)


@pytest.mark.parametrize("terms", QUERIES)
def test_by_relevance(shop, index, terms):
    everything = S.scored_matches(shop, " ".join(terms), S.PRODUCT_FIELDS)
    best = everything.orderBy(F.round("relevance", 9).desc(), F.desc_nulls_last("popularity_score"), "product_id").limit(9)
    got = O.top_by_relevance(index, terms, 9, seeds=1)
    assert rows(got, "product_id", F.round("relevance", 6)) == rows(best, "product_id", F.round("relevance", 6))
    scored = O.scored(index, terms)
    assert scored.count() == everything.count()


def test_few_blocks_are_read(spark, shop, tmp_path, monkeypatch):
    """Tasks cut blocks with their own constants, so only the ranges are small here."""
    monkeypatch.setattr(O, "RANGE", 100)
    order = [F.desc_nulls_last("popularity_score"), F.col("product_id")]
    index = O.build(shop, S.PRODUCT_FIELDS, str(tmp_path), order, "popularity_score")
    blocks, wanted = O.wanted_by_priority(index, ["common"], 10)
    assert blocks.count() >= 15 and wanted.count() <= 2
    reached, _, every = O.wanted_by_relevance(index, ["w39", "w38"], 3, seeds=2)
    assert reached.count() < every.count()
    got = O.top_by_relevance(index, ["w39", "w38"], 3, seeds=2)
    best = S.scored_matches(shop, "w39 w38", S.PRODUCT_FIELDS).orderBy(
        F.round("relevance", 9).desc(), F.desc_nulls_last("popularity_score"), "product_id").limit(3)
    assert rows(got, "product_id") == rows(best, "product_id")


def test_gaps_give_the_numbers_back(index):
    unpacked = O._postings(index.blocks(["common"])).select("number").collect()
    numbers = sorted(r[0] for r in unpacked)
    assert len(numbers) == len(set(numbers)) == 1470
    largest = index.blocks(["common"]).agg(F.max("n")).first()[0]
    assert largest <= O.BLOCK


def test_no_documents_are_scanned(index, capsys):
    """Scores come from postings of one bucket; the catalogue is read for the listed documents only."""
    O.scored(index, ["w3"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [(bucket" in plan.replace("#", " #").replace("isnotnull(bucket", "(bucket") and "PushedFilters: [" in plan
    assert plan.count("Location:") == 1


def test_empty_table(spark, shop, tmp_path):
    index = O.build(shop.limit(0), S.PRODUCT_FIELDS, str(tmp_path), [F.col("product_id")], "popularity_score")
    assert O.top_by_priority(index, ["w3"]).count() == 0 and O.top_by_relevance(index, ["w3"]).count() == 0


def test_blocks_are_cut_where_the_documents_lie(spark):
    """No row per word or posting is shuffled; blocks of unsorted documents hold every word, in every range, once."""
    rng = np.random.default_rng(3)
    data = [(int(k), float(k % 3), ["hot"] * int(rng.integers(0, 3)) + [f"w{w}" for w in rng.integers(0, 9, rng.integers(0, 4))], ["same"]) for k in rng.permutation(9000)]
    words = spark.createDataFrame(data, "number long, priority double, name array<string>, place array<string>").coalesce(2)
    blocks = O.sorted_blocks(words, ["name", "place"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Explode" not in plan and "rangepartitioning" not in plan
    expected = {(f, w, k): (ws.count(w), len(ws), p) for k, p, *both in data for f, ws in zip(("name", "place"), both) for w in ws}
    found = O._postings(blocks).collect()
    assert len(found) == len(expected) and {tuple(r[:3]): tuple(r[3:]) for r in found} == expected
    for b in blocks.collect():
        held = [expected[b["field"], b["term"], k] for k in np.cumsum([b["first"], *b["gaps"]])]
        assert b["n"] == len(held) <= O.BLOCK and {int(k) // O.RANGE for k in np.cumsum([b["first"], *b["gaps"]])} == {b["range"]}
        assert b["words"] == sum(tf for tf, _, _ in held) and b["most"] == max(tf for tf, _, _ in held)
        assert b["density"] == max(tf / length for tf, length, _ in held) and (b["low"], b["high"]) == (min(p for *_, p in held), max(p for *_, p in held))


def test_numbering_shuffles_rows_once(spark):
    """Only the range sort moves whole rows; the starts of its partitions are sent along."""
    plan = ordinal_ids(spark.range(100).withColumn("text", F.lit("t")), [F.col("id")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
