"""palinode: finding hidden instructions in text, scoring and auditing them, as Spark DataFrame plans."""

__version__ = "0.1.0"
