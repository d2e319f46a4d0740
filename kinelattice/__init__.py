"""Spark-native analytics for labelled frame series, and training-data operators in ``kinelattice.llm``."""
