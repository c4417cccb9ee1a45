import os
import subprocess
import sys

CODE = """
import sys; sys.path.insert(0, {root!r})
from tabeval.session import local_session
from __spark_entry__ import queries
spark = local_session(2, 2)
print("rows", queries()["z2_batched_scoring"](spark, {folder!r}).count())
print("rows", queries()["a9_correlation"](spark, {folder!r}).count())
"""


def test_workers_need_no_copy_of_the_package(small, tmp_path):
    """Python workers started in another folder get the functions with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", CODE.format(root=root, folder=small)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.split("\n")[:2] == ["rows 500", "rows 121"], done.stderr[-2000:]
