"""The command line end to end at sf0.001: build the dataset files, train, moderate a file."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF001 = "/root/testdata/sf0.001"


def _run(args, cwd):
    env = dict(os.environ, PYTHONPATH=REPO)
    out = subprocess.run([sys.executable, "-m", "toxscan", *args], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_build_train_moderate(tmp_path, spark):
    summary = json.loads(_run(["build", "--tables", SF001, str(tmp_path / "ds")], tmp_path).strip().splitlines()[-1])
    assert summary["all_0"] == 67 and summary["all_1"] == 9
    assert summary["train_balanced_0"] == summary["train_balanced_1"] == 50
    assert summary["kept"] == 76 and summary["seen"] == 200
    metrics = json.loads(_run(["train", "--tables", SF001, str(tmp_path / "model")], tmp_path).strip().splitlines()[-1])
    assert metrics["tp"] + metrics["fp"] + metrics["fn"] + metrics["tn"] == 20
    _run(["moderate", str(tmp_path / "ds" / "ratings_labeled_test.csv"), str(tmp_path / "model"),
          str(tmp_path / "out"), "--head", "100"], tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20
    assert out.filter(~out.report.startswith("label: ")).count() == 0
    # the file whose _id restarts in each class: every row comes out
    _run(["moderate", str(tmp_path / "ds" / "ratings_labeled.csv"), str(tmp_path / "model"), str(tmp_path / "all")], tmp_path)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 76


def test_build_from_posts(tmp_path, spark):
    rows = [(f"text {i} {'idiot' if i % 3 == 0 else 'nice'}", i % 3 == 0, 1 if i < 30 else 0) for i in range(40)]
    posts = spark.createDataFrame([(t, int(y), c) for t, y, c in rows], "string string, label int, labeling_confirm int")
    posts.write.json(str(tmp_path / "posts.json"))
    summary = json.loads(_run(["build", str(tmp_path / "posts.json"), str(tmp_path / "ds")], tmp_path).strip().splitlines()[-1])
    assert (summary["all_0"], summary["all_1"], summary["kept"], summary["seen"]) == (20, 10, 30, 40)
