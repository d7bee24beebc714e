"""The registered queries against their SQL on the smallest tables."""

import glob
import importlib
import os
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
entry = importlib.import_module("__spark_entry__")
OWN = importlib.import_module("mnemospark.plans.queries").QUERIES


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 250


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["dot_topk_batch", "action_key_topk", "ivf_probe_topk", "episode_walk", "bounded_degree_edges", "expand_d2", "recall_expanded_d1", "build_context", "fusion_alpha_05", "surprise_gate", "keep_scores", "compact_idmap", "compact_rows", "tiered_topk", "store_round_trip"])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    df = OWN[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    text = lambda v: f"{v + 0:.9g}" if isinstance(v, float) else str(v)
    want = sorted([text(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert sorted(names) == columns and sorted([text(r[c]) for c in columns] for r in df.collect()) == want
