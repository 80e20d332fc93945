import os
import subprocess
import sys


def test_failed_tasks_rerun_to_the_same_rows(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, os.path.join(repo, "tests", "retry_job.py"), repo, str(tmp_path)],
                         capture_output=True, text=True, timeout=600)
    assert "SAME" in out.stdout, out.stdout[-2000:] + out.stderr[-2000:]
    assert "failures 3" in out.stdout  # each of the 3 shard tasks failed once, then succeeded
