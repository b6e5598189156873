"""verdigris: a Spark library that checks a database migration and reports what differs."""
