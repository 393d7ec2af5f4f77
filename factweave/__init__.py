"""factweave: a Spark-native analytics engine for multi-tenant facts, documents, events and vectors."""
