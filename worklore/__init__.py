"""Work-history analytics over agent transcripts and project documents on Spark."""
