"""tidemill: a DataFrame-first engine for supervised analytics on Spark."""

__version__ = "0.1.0"
