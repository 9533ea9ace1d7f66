"""Scoring bookings as they arrive."""
