"""The library reaches executors as an archive."""

import os
import subprocess
import sys
import textwrap


def test_shipped_library_works_from_another_folder(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {home!r})
        from pyspark.sql import functions as F
        from tessera.functions import exact
        from tessera.session import local_session, ship
        spark = local_session(1, 1, "1g")
        ship(spark)
        assert spark.range(1).select(exact.slug(F.lit("A b"))).first()[0] == "a_b"
        spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
