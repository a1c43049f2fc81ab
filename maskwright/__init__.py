"""maskwright: PySpark-native detection, masking and restoring of personal data."""

__version__ = "0.1.0"
