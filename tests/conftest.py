from __future__ import annotations

import io
import os
import sys
import tarfile
from pathlib import Path

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftspark.session import get_spark  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture
def land(tmp_path):
    """Writes bundles the way sensors upload them."""

    class Landing:
        base = tmp_path / "landing"

        def put(self, sensor: str, stamp: str, members: dict[str, bytes], kind: str = "stats") -> Path:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
                for name, content in members.items():
                    info = tarfile.TarInfo(name)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
            return self.put_raw(sensor, stamp, buffer.getvalue(), kind)

        def put_raw(self, sensor: str, stamp: str, content: bytes, kind: str = "stats") -> Path:
            path = self.base / kind / sensor / stamp / f"{kind}.tar.gz"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
            return path

    return Landing()


@pytest.fixture
def sketch(spark):
    """Bytes of a float sketch over the given values."""

    def build(values) -> bytes:
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return bytes(df.selectExpr("kll_sketch_agg_float(cast(v as float)) s").first()["s"])

    return build
