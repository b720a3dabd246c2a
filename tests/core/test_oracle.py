"""Registered queries against their DuckDB SQL on the smallest tables."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest
from quay import catalog, registry

SF = "/root/testdata/sf0.001"
QUICK = [
    "file_classes", "class_buckets", "skipped_by_rule", "secret_buckets", "largest_files", "estimate_levels", "human_sizes", "root_split", "root_summary", "file_dedup",
    "solid_parts", "stored_parts", "block_parts", "volume_fold", "sums_check", "missing_volumes", "torn_journal", "trailer_check", "sanitized", "package_match", "found_apps",
    "install_plan", "config_plan", "install_commands", "command_outcomes", "resolved_paths", "excluded_globs",
    "conflict_actions", "restore_totals", "restore_roots", "collision_rename", "codec_round_trip", "appdb_problems", "reassembly",
    *(f.__name__ for f in registry.QUERIES),
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == columns
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(x) for x in r) for r in frame.select(*columns).collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
