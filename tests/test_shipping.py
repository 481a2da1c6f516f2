"""What runs in Python workers can be loaded where this package is missing."""
import subprocess
import sys

from pyspark import cloudpickle

from odonto.operators import fold, replay
from odonto.streaming import audits, payments


def test_workers_need_no_package(tmp_path):
    blob = tmp_path / "functions.bin"
    blob.write_bytes(cloudpickle.dumps((payments.BillBalance(), audits.LastImages(), replay._replay(True), fold._fold_batches, fold._fold_blocks)))
    code = ("import importlib.util, pickle; assert importlib.util.find_spec('odonto') is None; "
            f"_, _, *runs = pickle.load(open({str(blob)!r}, 'rb')); print([list(r(iter([]))) for r in runs])")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[[], [], []]"
