"""Smoke tests for the helper scripts and the bench output contract."""

import json
import os
import subprocess
import sys

from given_tables import ROOT, SF_SMALL


def _run(args, env=None):
    return subprocess.run([sys.executable, *args], cwd=ROOT, capture_output=True, text=True, timeout=600,
                          env={**os.environ, **(env or {})})


def test_check_oracle_script():
    out = _run(["scripts/check_oracle.py", SF_SMALL, "q03"])
    assert out.returncode == 0, out.stderr[-2000:]
    assert "q03_min_chars" in out.stdout and "mismatches: 0" in out.stdout


def test_explain_all_script():
    out = _run(["scripts/explain_all.py", SF_SMALL, "q03"])
    assert out.returncode == 0, out.stderr[-2000:]
    assert "===== q03_min_chars =====" in out.stdout and "PushedFilters" in out.stdout


def test_bench_prints_one_json_line():
    out = _run(["bench.py"], {"BENCH_SF_DIR": SF_SMALL, "BENCH_REPS": "1", "BENCH_QUERIES": "q03,q25"})
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"q03_min_chars", "q25_trials"}
    assert rec["failed"] == {} and rec["sf"] == 0.001


def test_package_reaches_workers_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "import __spark_entry__ as E\nfrom prefline.session import local_session, ship_package\n"
            "spark = local_session(cores=2)\nship_package(spark)\n"
            "for q in ('q08_random_prefix', 'q31_generate'):\n"
            "    print(q, len(E.queries()[q](spark, '/root/testdata/sf0.001').collect()))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "q08_random_prefix" in out.stdout and "q31_generate" in out.stdout
