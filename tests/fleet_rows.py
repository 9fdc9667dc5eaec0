"""Rows and constants that several test modules share."""

import datetime as dt
import decimal

from fleetkit import constants as K

AS_OF = K.AS_OF
TODAY = AS_OF.date()
SF_SMALL = "/root/testdata/sf0.001"


def d(days: int) -> dt.date:
    return TODAY + dt.timedelta(days=days)


def tool_row(code, name="Tool", category="Power Tools", location="Workshop", purchase=None,
             last=None, due=None, status="available", condition=10.0, hours=0.0, cost=0):
    t0 = dt.datetime(2001, 1, 1)
    return (code, name, category, location, purchase, last, due, status, condition, hours,
            decimal.Decimal(cost).quantize(decimal.Decimal("0.01")), t0, t0)
