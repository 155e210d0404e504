"""quarry: site-search corpora as Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected to the driver inside an operator. Sub-packages:

- ``sources``   table scans, derived views, feed/sitemap sources, sinks
- ``functions`` Column-level building blocks (tokenizer, URLs, phonetic keys)
- ``operators`` relational operators (index, search, vectors, store, frontier ...)
- ``plans``     registered query compositions used by ``__spark_entry__``
- ``streaming`` Structured Streaming jobs
"""

__all__ = ["schema", "session"]
