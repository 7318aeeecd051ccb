"""encore — listening-history analytics on Apache Spark.

``encore.sources`` reads exports and builds the curated plays table, ``encore.operators`` holds
the DataFrame operators, ``encore.plans`` the registered queries and report bundles, and
``encore.streaming`` the incremental ingest.
"""

__version__ = "0.1.0"
