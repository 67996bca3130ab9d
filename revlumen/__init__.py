"""Customer-review analytics as Spark DataFrame jobs.

Layout

* ``functions``  column-level building blocks (text, rules, time, prices)
* ``sources``    readers, writers and the review view over the event table
* ``operators``  DataFrame -> DataFrame operators (joins, grouping, windows)
* ``plans``      whole jobs composed from the operators
* ``streaming``  the same columns on Structured Streaming
"""

__version__ = "0.1.0"
