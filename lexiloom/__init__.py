"""Text-consistency, terminology and corpus operators on PySpark DataFrames."""
