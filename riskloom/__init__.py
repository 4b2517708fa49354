"""riskloom: entity-graph risk analytics as Spark DataFrame operators."""
