"""wavetable: label, clean, score and curate very large collections of series on Spark."""

__version__ = "0.1.0"
