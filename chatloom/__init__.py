"""chatloom: conversation-catalog analytics as Spark jobs."""
