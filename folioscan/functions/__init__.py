"""Patterns and column expressions shared by the operators."""
