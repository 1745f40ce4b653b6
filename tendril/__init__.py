"""tendril: Spark-native analytics for keyed care-and-measurement records.

Growth and health statistics, trends, alert lists, reminder boards,
point-in-time lookup on SCD2 tables, event rules (batch and streaming) and
data-quality splits, all as DataFrame functions over every key at once.
Every time-dependent function takes an explicit ``as_of``.
"""

__version__ = "0.1.0"
