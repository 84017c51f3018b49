"""emberglass: late, incomplete event data on Spark (detections, roads, settlements, scores)."""
