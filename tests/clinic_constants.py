"""Values shared by the clinic tests."""

import datetime as dt

SF001 = "/root/testdata/sf0.001"
AS_OF = dt.date(2026, 12, 2)   # a Wednesday
