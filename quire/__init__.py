"""Document analytics on Spark: files in, Markdown and tables out."""
