"""Weekly field analytics as DataFrame-to-DataFrame operators on Spark."""
