"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py"), "growth_statistics", "calendar"],
        env=env,
        capture_output=True,
        text=True,
        timeout=600,
        check=True,
    ).stdout.strip().splitlines()
    d = json.loads(out[-1])
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"growth_statistics", "calendar"}
    assert d["value"] == round(sum(d["queries"].values()), 3)
