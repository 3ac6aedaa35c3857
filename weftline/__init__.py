"""weftline: data unification, data quality and corpus preparation on Spark."""
