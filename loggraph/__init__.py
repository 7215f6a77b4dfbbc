"""loggraph: forensic log analytics on Spark.

Raw server logs -> one-scan parse -> scored SSH / HTTP edges -> signal/noise graph,
cluster overview, drill-down and time correlation, all as DataFrame jobs. See the
README for the module map and the design for scale.
"""

__version__ = "0.1.0"
