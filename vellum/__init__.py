"""vellum: a PySpark-native context and analytics engine over collections of notes and tables."""

__version__ = "0.1.0"
