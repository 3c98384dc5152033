"""The stateless operators over streams of text lines."""
