"""Lake food-web analytics as Spark jobs: every operator is a DataFrame -> DataFrame function."""
