"""Reading pages and sitemaps."""
