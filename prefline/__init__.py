"""prefline: preference-data preparation and reward computation on Spark.

Every public operator is ``DataFrame -> DataFrame`` or ``Column -> Column``.
Python workers run only where a model has to (generator, external scorer)
and for the vectorised Arrow vocabulary lookup; everything else is built-in
Spark expressions, aggregates and joins.  See README.md for the layout.
"""

__version__ = "0.1.0"
