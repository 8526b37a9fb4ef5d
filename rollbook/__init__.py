"""rollbook: attendance-sheet analytics and large-corpus operators on Spark."""
