"""bench.py prints exactly one JSON line on stdout (the driver parses it)."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF001


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_REPEAT="1", BENCH_QUERIES="d13_summary,e11_rsi", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600, cwd="/tmp")
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == "0.001"
    assert set(rec["queries"]) == {"d13_summary", "e11_rsi"}
    assert rec["value"] == round(sum(rec["queries"].values()), 3)
