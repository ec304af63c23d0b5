"""heddle: transaction-network analytics and corpus operators on Spark."""
