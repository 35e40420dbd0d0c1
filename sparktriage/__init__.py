"""Case-triage analytics as PySpark DataFrame plans."""
