import os
import sys
import tempfile
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronotape.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def minute_bars(spark, closes, highs=None, lows=None, volumes=None, start="2025-03-03T14:30:00", symbol="ABCD",
                session="2025-03-03", opens=None):
    """Bars from 09:30 New York time, one per minute, with bid/ask and session marks."""
    from pyspark.sql import functions as F
    from chronotape.operators.bars import mark_session
    t0 = utc(start)
    rows = []
    for i, c in enumerate(closes):
        h = highs[i] if highs else c
        lo = lows[i] if lows else c
        o = opens[i] if opens else c
        rows.append((symbol, session, i, t0 + timedelta(minutes=i), float(o), float(h), float(lo), float(c),
                     int(volumes[i]) if volumes else 100))
    df = spark.createDataFrame(rows, "symbol string, session string, seq bigint, ts timestamp, open double, high double, "
                                     "low double, close double, volume bigint")
    return mark_session(df.withColumn("bid", F.col("close") - 0.01).withColumn("ask", F.col("close") + 0.01))
