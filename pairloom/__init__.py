"""pairloom: matching studies and treatment-effect simulation as Spark jobs."""
