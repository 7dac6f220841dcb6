"""Queries against their SQL on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexweave.plans.queries_documents import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SOME = ["q01_top_referenced", "q02_outgoing_targets", "q09_all_mentions", "q11_containment", "q13_resolution", "q18_numbering_and_merge", "q21_markdown_scan", "q23_units", "q26_footnotes", "q31_merged_rows", "q37_loss", "q41_cells_by_gap", "q46_styled_lines", "q50_column_anchors", "q56_detected_lookback60", "q62_list_depths", "q65_row_continuations", "q69_loose_rows", "q75_section_report", "q79_region_cells"]


def _rows(frame, columns):
    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return [plain(x) for x in v]
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else v

    return sorted((tuple(str(plain(v)) for v in r) for r in frame[columns].astype(object).values.tolist()))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "documents", "pages", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(want.columns)) and len(got)


def test_every_sql_names_a_query():
    assert set(SQL) <= set(QUERIES)
