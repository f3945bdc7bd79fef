"""Files to paragraphs."""
