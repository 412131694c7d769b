"""tracelode: logs, metrics and traces analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
