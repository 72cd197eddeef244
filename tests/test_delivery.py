"""Functions for Python workers travel with their tasks."""

import os
import subprocess
import sys
import textwrap


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    # the driver finds the package by sys.path alone, which workers do not inherit
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        from seriesmill.operators.arma import Arma, arma_residuals
        rows = [("a", t, float(t % 5)) for t in range(40)]
        df = spark.createDataFrame(rows, "series string, t int, x double")
        print("rows", arma_residuals(df, ["series"], "t", "x", Arma(phi=(0.5,), theta=(0.3,))).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40" in done.stdout, done.stderr[-2000:]
