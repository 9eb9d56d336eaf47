"""Each query beside its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from feria.plans import jobs, more, payloads, repair, search  # noqa: F401  register their queries
from feria.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
#: Enough of each kind for one run; the driver compares all of them.
SOME = ["F1_F5_valid_prices", "A5_price_aggregate", "A9_daily_series", "A14_basket_by_store", "A22_category_tree", "J17_blocked_pairs", "O1_biggest_drops", "T14_T15_ean", "E1_dice", "P4_insert_new", "T1_T2_plain_text", "J18_word_candidates", "J7_offers_of_every_store", "A12_cross_store_median", "M13_suspects", "E13_merge_by_code", "E16_other_sizes", "E17_retagged", "E11_E18_orphan_links", "A34_modal_packs", "D2_local_day", "T21_fulltext", "E4_E7_match_altered", "E10_E11_repaired_links", "E12_link_decisions", "E14_consolidated", "E15_rematched", "M12_difference_hash", "S4_search_records", "S8_embedded_cache"]


def rows(df):
    cols = sorted(df.columns)
    show = lambda v: "NULL" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(show, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_names():
    assert set(ORACLES) <= set(QUERIES)
