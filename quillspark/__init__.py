"""PySpark-native evidence analytics: DataFrame in, DataFrame out."""
