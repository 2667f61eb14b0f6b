"""pagewright: images to ordered, queryable text on Spark."""
