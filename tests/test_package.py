"""The package from another working folder."""

import pathlib
import subprocess
import sys

HOME = pathlib.Path(__file__).parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
import wardlight
from wardlight.operators import moderation
spark = wardlight.ship(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate())
print("clean:", [r.c for r in spark.createDataFrame([("a thing",), ("fine",)], "text string").select(moderation.is_clean("text").alias("c")).collect()])
"""


def test_from_another_folder(tmp_path):
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(home=str(HOME))], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "clean: [False, True]" in ran.stdout, ran.stderr[-2000:]


def test_the_entry_module_needs_no_training_text_operators(tmp_path):
    """Without their folders it imports; a broken import inside them is not hidden."""
    import shutil

    shutil.copy(HOME / "__spark_entry__.py", tmp_path)
    shutil.copytree(HOME / "wardlight", tmp_path / "wardlight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op1') for k in e.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert ran.returncode == 0 and ran.stdout.split()[1] == "0", ran.stderr[-2000:]
