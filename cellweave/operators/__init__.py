"""DataFrame operators on long series: a key (`by`), a time, a value; null is the only missing value.

`by` names the columns of a series: a cell, or none for all pooled. Values that
are NaN count as null (`series.clean`). No operator changes its input's rows
unless it says so.
"""
