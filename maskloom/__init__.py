"""maskloom: personal-data labelling, scoring and simulation as Spark DataFrame jobs."""
