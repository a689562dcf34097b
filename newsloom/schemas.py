"""Schemas of the records."""

from __future__ import annotations

from pyspark.sql import types as S

IMAGES = S.ArrayType(S.StructType().add("url", "string").add("alt", "string").add("width", "integer").add("height", "integer"))
METADATA = S.StructType().add("og_title", "string").add("og_description", "string").add("og_image", "string").add("canonical_url", "string").add("keywords", S.ArrayType(S.StringType())).add("language", "string").add("word_count", "integer").add("reading_time_minutes", "double")
ARTICLE = S.StructType().add("article_id", "string", False).add("url", "string", False).add("source_url", "string").add("source", "string", False).add("search_query", "string").add("title", "string", False).add("author", "string").add("published_at", "timestamp").add("body", "string").add("snippet", "string").add("images", IMAGES).add("thumbnail_url", "string").add("metadata", METADATA).add("tags", S.ArrayType(S.StringType())).add("status", "string", False).add("scraped_at", "timestamp").add("processing_time_ms", "double").add("error_message", "string")
SEARCH_RESULT = S.StructType().add("query", "string").add("title", "string").add("url", "string").add("snippet", "string").add("source", "string").add("rank", "integer")
API_ARTICLE = S.StructType().add("title", "string").add("url", "string").add("description", "string").add("author", "string").add("published_at", "timestamp").add("source_name", "string").add("url_to_image", "string").add("content", "string")
#: Raw rows of the news API, as its JSON has them.
API_RAW = "status string, totalResults int, message string, articles array<struct<title: string, url: string, description: string, author: string, publishedAt: string, source: struct<id: string, name: string>, urlToImage: string, content: string>>"
