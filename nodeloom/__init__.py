"""nodeloom: graph and community analytics as Spark DataFrame plans."""
