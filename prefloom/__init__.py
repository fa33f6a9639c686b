"""prefloom: preference-data building and evaluation on Spark DataFrames.

Every public function takes DataFrames (and plain keyword parameters) and
returns a DataFrame or a Column; nothing holds a global session.
"""

__version__ = "0.1.0"
