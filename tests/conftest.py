import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetkit import schemas  # noqa: E402

from fleet_rows import d, tool_row  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from fleetkit.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="fleetkit-tests")
    yield s


@pytest.fixture
def make_tools(spark):
    def _make(rows):
        return spark.createDataFrame(rows, schemas.TOOLS)
    return _make


@pytest.fixture
def sample_tool():
    # the reference's sample record (condition 8.5, bought 2023-01-15, due in 30 days)
    return tool_row("TEST-001", "Test Pneumatic Drill", "Power Tools", "Test Workshop",
                    purchase=dt.date(2023, 1, 15), due=d(30), condition=8.5)


@pytest.fixture
def seed_tools():
    """Five seed tools over four categories (due +30/+15/+60/+90/+45 days,
    condition 8.5/9.2/9.8/9.5/9.0) — inserted only into an empty table."""
    spec = [("SEED-PWR-1", "Pneumatic Drill", "Power Tools", 30, 8.5),
            ("SEED-PWR-2", "Impact Wrench", "Power Tools", 15, 9.2),
            ("SEED-HND-1", "Torque Wrench Set", "Hand Tools", 60, 9.8),
            ("SEED-MSR-1", "Digital Multimeter", "Measuring Tools", 90, 9.5),
            ("SEED-SFT-1", "Safety Harness", "Safety Equipment", 45, 9.0)]
    return [tool_row(c, n, cat, "Workshop", purchase=dt.date(2001, 1, 15), due=d(days), condition=cond)
            for c, n, cat, days, cond in spec]
