"""driftlens: text-label classification and domain-shift analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Catalyst
expressions; nothing here collects data to the driver except label-level
dimension tables whose size is checked first.
"""

__version__ = "0.1.0"
