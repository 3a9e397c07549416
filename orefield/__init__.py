"""orefield: Spark-native analysis of legacy mainframe source estates.

Everything is a function from DataFrames to DataFrames.  ``orefield.llm`` holds the operators for
training-data pipelines; nothing outside that subpackage imports it.
"""

__version__ = "0.1.0"
