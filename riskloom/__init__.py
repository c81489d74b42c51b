"""Safety-report triage and risk analytics as PySpark DataFrame operators."""
