"""factorlake: factor research on market panels as Spark DataFrame jobs."""
