"""tracelake: a PySpark-native analytics engine for retrieval-augmented generation traces.

Subpackages
-----------
functions   column expressions (strings, hashes, JSON, time), all JVM-side unless said otherwise
operators   relational operators built on DataFrames
sources     scans and sinks
streaming   incremental operators (Structured Streaming)
plans       the registry of named queries and their SQL twins
llm         operators for training-data preparation; nothing else in the library imports it
"""

__version__ = "0.1.0"
