"""Every operator's functions travel with its tasks: workers need no copy of the package."""

import os
import subprocess
import sys
import textwrap


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "job.py"
    # the driver finds the package by sys.path alone, which workers do not inherit
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r})
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        from seriesmill.llm.queries import QUERIES
        for name, query in QUERIES.items():
            query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
            print("done", name, flush=True)
        print("all", len(QUERIES))
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all 13" in done.stdout, done.stdout + done.stderr[-2000:]
