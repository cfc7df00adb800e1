"""Statistical analysis of tables as Spark jobs: profile, clean, recommend, analyse."""

__version__ = "0.1.0"
