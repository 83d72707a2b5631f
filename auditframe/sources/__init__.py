"""Readers that turn logs, schema dumps, source trees and documents into tables."""
