"""Catalog matching on Spark: standardize item tables, embed, search, sync, and read feedback.

Everything here takes and returns DataFrames.  The sub-packages are

``functions``   column expressions (text folding, measures, token similarity, scores)
``operators``   DataFrame operators built from them
``sources``     readers and writers with declared schemas
``plans``       the composite jobs: standardization, search, sync
``streaming``   the incremental versions of sync and feedback statistics
``registered``  the queries over the driver tables, each next to its SQL twin
"""

__version__ = "0.1.0"
