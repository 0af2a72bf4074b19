"""Spark toolkit for preparing biodiversity tables for publication."""
