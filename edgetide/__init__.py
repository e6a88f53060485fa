"""edgetide: temporal-graph analytics on PySpark.

Logs of edge updates become two relations, first arrivals and alive
intervals, and every report is a declarative query over them.
"""
