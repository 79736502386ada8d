"""curata: a Spark-native engine for curating training data.

Every operator is a lazy ``DataFrame -> DataFrame`` function; nothing here
collects data to the driver beyond small, size-checked metadata.
"""
