"""pagemill: a site-analytics engine that turns tables of web pages into structured data with Spark."""

__version__ = "0.1.0"
