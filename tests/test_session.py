"""The package reaches workers that haven't it on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from siltstone.session import local, ship
spark = local("2", **{{"spark.checkpoint.dir": "file://{shared}"}})
ship(spark)
from siltstone.functions.urls import canonical_url
print(spark.createDataFrame([("HTTP://E.com/a#b",)], "u string").select(canonical_url("u")).head()[0])
"""


def test_sources_are_shipped_through_the_shared_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, shared=tmp_path)], env=env, cwd="/", capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("http://e.com/a"), done.stderr[-2000:]
    assert any(f.endswith(".zip") for f in os.listdir(tmp_path))
