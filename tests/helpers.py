"""Small input tables and plain NumPy counterparts."""

from __future__ import annotations

import datetime as dt

import numpy as np

START = dt.date(2020, 1, 5)


def weekly(spark, series, start=START):
    """{id: values} to a weekly panel."""
    rows = [(k, start + dt.timedelta(days=7 * i), None if v is None else float(v))
            for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, date date, storage double")


def capacities(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()],
                                 "id long, capacity double")


def km(lat1, lon1, lat2, lon2):
    la1, lo1, la2, lo2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
