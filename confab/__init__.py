"""confab: conversation analytics and training-data preparation on Spark."""
