"""Millrace: analytical operators for Spark, written as DataFrame -> DataFrame functions."""
