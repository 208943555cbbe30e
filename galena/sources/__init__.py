"""Readers of tables, daily weather and flow records, candles and gridded fields."""
