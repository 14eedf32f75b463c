"""Readers of raw measurement files and of the tables that play their part, and writers of banks."""
