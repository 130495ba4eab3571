"""tessera — a Spark-native text-corpus, retrieval and ranking library.

Every operator takes DataFrames and returns DataFrames; the heavy lifting is
expressed with the DataFrame API so Catalyst can prune, push down and plan
shuffles.  See README.md for the module map.
"""

__version__ = "0.1.0"
