"""A Spark engine for conversational memory: logs, retrieval, facts, memories, sketches and behaviour."""
