"""Every query with SQL gives the same rows in DuckDB."""

from decimal import Decimal

import duckdb
import pytest

from parlance.plans import catalogue
from parlance.plans.registry import ORACLES, QUERIES, query

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations embeddings pages".split()
#: The widest plans, one for each family; the driver compares all queries.
CHOSEN = "tok_offsets all_ngrams capitalize_flag stopword_blank rare_word_gate punct_variations surface_expansion builtin_number gazetteer_dedupe placeholders lookup_parse lookup_powerset pattern_slots slot_resolution engine_parse engine_slots builtin_calendar gazetteer_strictness configured_features cooc_select bilou_bounds vocab_restrict kfold_assign tfidf_transform chi2_select cooc_pairs bilou_encode bio_decode augment_cyclic noise_words prf1_rollup annotated_parse".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    plain = lambda v: round(float(v), 5) if isinstance(v, float | Decimal) else v
    rows = lambda t: sorted((tuple(map(plain, r)) for r in zip(*(t[c].to_pylist() for c in columns))), key=repr)
    assert rows(got) == rows(want)


def test_catalogue_is_consistent():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    with pytest.raises(ValueError):
        query()(QUERIES["tok_offsets"])


def test_flagship(spark):
    row = catalogue.flagship(spark, SF).where("slot_name = 'product'").first()
    assert row["resolved"] == row["raw_value"].upper()
