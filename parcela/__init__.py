"""Spark-native cleaning, auditing and searching of scraped listing data."""
