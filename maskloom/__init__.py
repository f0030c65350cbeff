"""maskloom: reversible de-identification of text and conversations as Spark jobs."""
