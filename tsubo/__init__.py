"""tsubo: rental-listing analytics as Spark DataFrame jobs."""
