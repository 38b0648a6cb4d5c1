"""Spark-native evidence retrieval and memory-lifecycle library.

Every operator takes DataFrames and returns DataFrames.  Time is always passed
in (``now``), never read from the clock, so a plan is a pure function of its
inputs and can be re-run after an executor loss with the same result.
"""

__version__ = "0.1.0"
