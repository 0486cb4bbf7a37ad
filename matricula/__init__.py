"""matricula: admissions-catalog, ranking and faculty-directory analytics on Spark."""

__version__ = "0.1.0"
