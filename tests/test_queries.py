"""Every registered query runs on the smallest tables, and equals its DuckDB form."""

import duckdb
import pandas as pd
import pytest

from candor import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: [plain(x) for x in v] if hasattr(v, "__iter__") and not isinstance(v, (str, dict)) else None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_contained_items_of_few_words(spark, tmp_path):
    items = ["a", "ab", "bcd", "longword", "b c", "ab cd", "x yz", "ab cd ef", "b cd e", "one two three four", "e two three four fiv", "one two three four five", "ne two three four five si", "", None, "ab", "b c", "the end", "zz top", "ab cd ef"]
    texts = ["xab cdy", "ab cd ef", "ab cd", "b", "c", "bcd", "alongwordy", "one two three four five six", "one two three four fivex", "someone two three four", "b cdx", None, "", "ab! cd? ef", "x yzz", "zzz topper the ending", "ab cd ef ab cd ef", "a b c d e"]
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert rows(catalog.QUERIES["j09_contained_items"](spark, str(tmp_path)).toPandas()) == rows(c.sql(catalog.ORACLES["j09_contained_items"]).df())


@pytest.mark.parametrize("n", [33, 34, 35, 63, 66])
def test_feature_vectors_where_the_last_step_is_cut(spark, tmp_path, n):
    """The last step has one, two, three or all but one of its layers; only whole generations count."""
    pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet").query("vec_id < @n").to_parquet(tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = rows(catalog.QUERIES["m04_m11_a08_feature_vector"](spark, str(tmp_path)).toPandas())
    assert len(got) == 35 * (n // 32) and got == rows(c.sql(catalog.ORACLES["m04_m11_a08_feature_vector"]).df())


@pytest.mark.parametrize("most", [0, 2000])
def test_contained_items_with_and_without_chosen_places(spark, tmp_path, monkeypatch, most):
    """Keys at all places and at chosen ones give the same, also where most words are some item's."""
    from candor.plans import text_queries

    monkeypatch.setattr(text_queries, "KEY_WORDS", most)
    monkeypatch.setattr(text_queries, "BROADCAST_HITS", most)
    items = ["a b c d e f", "b a c d e f", "a b c", "x a b c d y z", "d e f a b c a b c", "f", "lone wolf", "a b c d e f", None]
    texts = ["a b c d e f", "xa b c d e fx", "b a c d e", "a " * 40 + "b c d e f", "x a b c d y zed", "the d e f a b c a b cat", "", None, "alone wolfs f", "a b c d e f " * 30]
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert rows(catalog.QUERIES["j09_contained_items"](spark, str(tmp_path)).toPandas()) == rows(c.sql(catalog.ORACLES["j09_contained_items"]).df())


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and not set(catalog.ORACLES) - set(catalog.QUERIES)
