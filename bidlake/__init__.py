"""bidlake: procurement analytics and corpus preparation as Spark DataFrame operators."""
