"""Column functions over text, bytes and lists; all of them are Spark expressions unless they say otherwise."""
