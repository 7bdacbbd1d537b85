"""Spark-native factor research on ``(stock_id, date)`` panels."""
