"""Registered queries against their SQL on the smallest given tables; tools/check.py runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["sig_13_window_records", "geo_18_union_then_fill", "geo_23_map_cues", "fea_12_window_table", "pu_16_calibrate_tau", "tmp_09_episodes",
          "emb_08_robust_scale", "grf_12_adjacency", "grf_15_teacher", "evl_03_match_gt", "evd_14_llm_input", "llm_04_validate_output",
          "kb_09_ingest_gt", "kb_20_check_lineage", "s6_05_prompt_consensus", "ret_13_precision_coverage", "src_13_upsert", "spl_01_make_splits"]


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(r[k] for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, res.fetchall())


def test_every_query_has_a_unique_inventory_name():
    names = entry.queries()
    assert len(names) >= 240 and set(entry.oracle_sql()) <= set(names)
