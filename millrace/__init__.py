"""Event and record analytics as plain DataFrame operators."""
