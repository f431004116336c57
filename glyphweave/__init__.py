"""Document-layout analytics on Spark: pages to operations, glyphs, words, lines and blocks, and queries over them."""
