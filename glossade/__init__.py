"""glossade: lexical-shift analytics over large multilingual corpora, written as Spark plans."""

__version__ = "0.1.0"
