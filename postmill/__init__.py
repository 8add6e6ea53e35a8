"""Job-posting ETL and analytics as Spark DataFrame jobs."""
