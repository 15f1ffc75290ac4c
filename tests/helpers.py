"""Values that several test modules share."""

import datetime as dt

NOW = dt.datetime(2026, 5, 23, 12, 0, 0)
