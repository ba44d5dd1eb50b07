"""A Spark-native data-preparation engine: every operator is a DataFrame transformation that Catalyst plans."""
