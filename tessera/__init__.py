"""Media encode planning and training-text preparation as Spark plans."""
