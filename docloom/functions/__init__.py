"""Column functions: text and names, URLs, releases and classes, HTML."""
