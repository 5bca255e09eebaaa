"""quantora: a PySpark-native analytics engine for bills of quantities and settlement audits."""

__version__ = "0.1.0"
