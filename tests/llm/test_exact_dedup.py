"""Exact duplicates against a dictionary of whole texts."""

import hashlib
import re

import pytest

from shelfwise.llm.exact_dedup import exact_duplicates

COLUMNS = "doc_id long, text string, digest string, length int, best string, place long"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, sorted."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        ids = [None if null else doc_id for _, null, doc_id in members]
        out += [(doc_id, ids[0], len(ids), k == 0, sha) for k, doc_id in enumerate(ids)]
    return sorted(out, key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", 7) for d, t in rows], COLUMNS)


def found(df, **options):
    return sorted((tuple(r) for r in exact_duplicates(df, **options).collect()), key=repr)


LONG = "long words again " * 30_000
ODD = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb\n"), (None, "ab"), (None, "a   b    "), (5, None), (6, ""), (7, " \n\t\x0b\x0c\r"),
    (8, "é x"), (9, "éx"), (10, " x"), (11, "x"), (12, LONG), (13, LONG + " "), (14, LONG + "."), (2, "ab"), (2, "ab"), (-3, "a  b"),
]


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1}, {"hot_rows": 2, "salts": 3}, {"digest_bytes": 1, "hot_rows": 1, "salts": 2}])
def test_odd_rows(spark, options):
    """Nulls, ties, repeated rows, long texts and clashing names, with shared digests and salted groups."""
    assert found(documents(spark, ODD).repartition(5), **options) == brute(ODD)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "same text")] * 50 + [(2, "other")]
    result = exact_duplicates(documents(spark, rows).repartition(7), hot_rows=10).collect()
    assert sum(r["kept"] for r in result if r["doc_id"] == 1) == 1 and len(result) == 51


def test_copies_of_a_third_of_all_rows(spark):
    """What any task reads of a hot group is a row per task that sent some."""
    rows = [(k, "the same words everywhere" + " " * (k % 5) if k % 3 == 0 else f"text number {k // 2}") for k in range(3000)]
    assert found(documents(spark, rows).repartition(16), hot_rows=100) == brute(rows)


def test_empty_table(spark):
    result = exact_duplicates(documents(spark, []))
    assert result.count() == 0 and result.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
