"""bench.py prints exactly one JSON line in the driver's format."""

import json
import os
import subprocess
import sys

from folders import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_QUERIES="genre_rank,collab_tiers")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001"
    assert set(d["queries"]) == {"genre_rank", "collab_tiers"}
    assert d["value"] == round(sum(d["queries"].values()), 3)
    assert "failed" not in d
