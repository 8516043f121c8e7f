"""The package reaches Python workers whatever the working folder is."""

import os
import subprocess
import sys
from pathlib import Path

from cohortloom import session

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from cohortloom.session import build_session
from cohortloom.operators import lloyd
spark = build_session("elsewhere", master="local[2]", shuffle_partitions=2, spark__ui__enabled="false")
rows = [("s", str(i), [float(i % 2), 0.0]) for i in range(20)]
points = spark.createDataFrame(rows, "space string, key string, x array<double>")
fits = lloyd.fit_sets(points, ["s"], [2], 1, 1)
print("COST", fits["s", 2].cost, sorted(fits["s", 2].counts))
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "COST 0.0 [np.float64(10.0), np.float64(10.0)]" in done.stdout, done.stderr[-2000:]


def test_package_is_sent_once(spark):
    session.ship_package(spark)
    assert sum(name.endswith("cohortloom.zip") for name in spark.sparkContext.listFiles) == 1
