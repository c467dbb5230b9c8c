"""Assignment and deduplication over streams."""
