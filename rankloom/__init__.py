"""Ranking, screening and back-testing of listed securities as Spark DataFrame plans."""
