"""Message-risk analytics and data preparation on Spark."""
