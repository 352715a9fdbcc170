"""bench.py prints one JSON line with the keys the driver reads."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF001


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_QUERIES="account_totals,organic_summary,no_such_query")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"account_totals", "organic_summary"}
    assert d["value"] == round(sum(d["queries"].values()), 4)
    # A failing query is reported, not fatal: the line is still printed.
    assert set(d["errors"]) == {"no_such_query"}
