import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from hangstats.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def lines_frame(spark, texts):
    return spark.createDataFrame([(text,) for text in texts], "value string")


def final_plan(frame):
    """Run a frame and return the text of the plan that ran, subqueries included."""
    frame.collect()
    kept, skipped_from = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        start = len(line) - len(line.lstrip(" :+-"))
        if skipped_from is not None and start >= skipped_from:
            continue
        skipped_from = start if "== Initial Plan ==" in line else None
        if skipped_from is None:
            kept.append(line)
    return "\n".join(kept)
