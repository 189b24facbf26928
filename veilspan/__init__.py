"""PII detection, redaction, masking and evaluation as PySpark DataFrame operators."""
