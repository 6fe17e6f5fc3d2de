"""Operators on timetable, observation, transfer and itinerary tables."""
