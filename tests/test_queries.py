"""Every registered query of the retrieval engine against its SQL."""

import pytest

from lumenfold.queries import ALL


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_matches_sql(name, same):
    same(*ALL[name])


def test_ann_recall_is_a_share(spark, sf_dir):
    (row,) = ALL["knn_ann_recall"][0](spark, sf_dir).collect()
    assert 0 <= row["recall"] <= 1


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
