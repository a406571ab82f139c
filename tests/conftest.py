import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"
BASE_US = 1_767_279_600_000_000  # 2026-01-01T15:00:00Z

TAPE_DDL = (
    "trade_id string, event_us long, symbol string, price double, quantity double, side string,"
    " account_id string, counterparty_id string, venue string, currency string, label string"
)


@pytest.fixture(scope="session")
def spark():
    from tapewarden.session import local_session

    session = local_session("tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()


def trade(offset=0.0, price=100.0, quantity=100.0, side="buy", symbol="AAPL", account=None, counter=None, label=None, name=None):
    us = BASE_US + round(offset * 1_000_000)
    return [name, us, symbol, price, quantity, side, account, counter, "X", "USD", label]


def tape(spark, trades):
    """Number the trades in the given order where they have no name."""
    rows = [tuple([t[0] or f"t{i:06d}", *t[1:]]) for i, t in enumerate(trades)]
    return spark.createDataFrame(rows, TAPE_DDL)
